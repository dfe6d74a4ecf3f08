"""What the operators ask of the session: a shared folder and cut lineage."""

from holdlens.sources.shared import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "cut"]
