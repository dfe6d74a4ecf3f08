"""A Merkle manifest of documents: one ternary tree for each source, and one over the sources.

Nodes of a tree are numbered, and ``FANOUT ** levels`` neighbours are a superblock. Going up, each superblock is reduced to one
node in a task of its own, round by round, until a tree has one. Going down, a superblock's nodes are cogrouped with the one row
of outer nodes that its proofs need; at the leaves that call reduces the block, joins local and outer siblings to proofs and folds
each leaf to a root. No task holds more than a superblock, and rounds grow with the logarithm of the largest source.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.llm.cluster import cut

#: Nodes that make one of the next level.
FANOUT = 3
#: Levels that one superblock has inside, so that it has 729 nodes.
LEVELS = 6

_KEYS = ["tree", "block"]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def counted(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, a colon and the value."""
    x = c.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*(counted(f) for f in fields)), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def reduce_nodes(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the levels above them; the last run may be shorter, even one node."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands before and after the node ``at`` in its run, for each level below the last one."""
    before, after = [], []
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        before.append("".join(nodes[first:at]))
        after.append("".join(nodes[at + 1 : first + FANOUT]))
        at //= FANOUT
    return before, after


def fold(node: str, before: list[str], after: list[str]) -> str:
    """The root that ``node`` has with these siblings."""
    for a, b in zip(before, after, strict=True):
        node = digest(a + node + b)
    return node


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 by ``order`` in their ``tree``, and ``n``, the tree's rows: range partitions and their totals."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()))
    of_tree = Window.partitionBy("tree")
    totals = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("tree", "part", before.alias("before"), F.sum("rows").over(of_tree).alias("n"))
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return ranged.withColumn("place", within).join(totals, ["tree", "part"]).withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def _block(levels: int) -> Column:
    return F.expr(f"place div {FANOUT**levels}").alias("block")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``levels`` higher, or the top of trees that are lower."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n = int(pdf.n.iloc[0])
        top = reduce_nodes(pdf.digest.tolist(), min(levels, height(n)))[-1]
        return pd.DataFrame({"tree": pdf.tree.iloc[:1], "place": pdf.block.iloc[:1], "n": -(-n // FANOUT**levels), "digest": top})

    return nodes.select("tree", _block(levels), "place", "n", "digest").groupBy(*_KEYS).applyInPandas(run, "tree string, place long, n long, digest string")


def _tree(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes(tree, place, n, digest)`` and the rounds above them; the last has one node a tree."""
    out = [nodes]
    n = nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        out.append(cut(_up(out[-1].select("tree", "place", "n", "digest"), levels)))
        n = -(-n // FANOUT**levels)
    return out


def _down(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The outer nodes of each of ``nodes``, from those of their superblocks."""

    def run(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("place")
        made = reduce_nodes(inner.digest.tolist(), min(levels, height(int(inner.n.iloc[0]))))
        o = above.iloc[0]
        paths = [siblings(made, i) for i in range(len(inner))]
        return pd.DataFrame({
            "tree": inner.tree, "place": inner.place, "subroot": o.subroot, "root": o.root,
            "before": [[*b, *o.before] for b, _ in paths], "after": [[*a, *o.after] for _, a in paths],
        })

    left = nodes.select("tree", _block(levels), "place", "n", "digest").groupBy(*_KEYS)
    right = outer.withColumnRenamed("place", "block").groupBy(*_KEYS)
    return left.cogroup(right).applyInPandas(run, "tree string, place long, subroot string, root string, before array<string>, after array<string>")


def _prove(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Proofs and folded roots of ``leaves``: a superblock and its outer nodes in one call."""

    def run(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("place")
        leaf = inner.digest.tolist()
        made = reduce_nodes(leaf, min(levels, height(int(inner.n.iloc[0]))))
        o = above.iloc[0]
        proofs, folded = [], []
        for i, found in enumerate(inner.found):
            b, a = siblings(made, i)
            b, a = [*b, *o.before], [*a, *o.after]
            proofs.append(digest("".join(x + y for x, y in zip(b, a, strict=True))))
            folded.append(fold(found, b, a))
        return pd.DataFrame({"id": inner.id, "leaf": leaf, "subroot": o.subroot, "root": o.root, "proof_sha256": proofs, "folded_root": folded})

    # as text, since ids may be null
    left = leaves.select("tree", _block(levels), "place", "n", "digest", "found", F.col("id").cast("string").alias("id")).groupBy(*_KEYS)
    right = outer.withColumnRenamed("place", "block").groupBy(*_KEYS)
    return left.cogroup(right).applyInPandas(run, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def merkle_manifest(docs: DataFrame, found_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row.

    docs: ``(doc_id, source, lang, n_chars, text)``; other columns are not read. ``found_text``: the text as found now, where that may
    differ from the one in the manifest; ``folded_root`` folds its leaf with the manifest's siblings, and ``verified`` says
    whether that is the root. ``levels``: of a superblock. Nulls in any column count as ``-``; null ids come first in their source, a null source first of all. Rows that repeat
    have a leaf and a place each (equal ids are ordered by leaf). An empty table gives an empty table.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    # a null source sorts before every text
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    leaf = leaf_of(*fields)
    found = leaf if found_text is None else leaf_of(*fields[:-1], found_text)
    rows = cut(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf.alias("digest"), found.alias("found"), F.monotonically_increasing_id().alias("tie")))
    leaves = cut(_numbered(rows, ["id", "digest", "tie"]))
    rounds = _tree(leaves, levels)
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = cut(_numbered(tops, ["name"]))
    upper = _tree(sources, levels)
    none = F.array().cast("array<string>")
    outer = upper[-1].select("tree", "place", F.col("digest").alias("subroot"), F.col("digest").alias("root"), none.alias("before"), none.alias("after"))
    for nodes in reversed(upper[:-1]):
        outer = cut(_down(nodes, outer, levels))
    named = sources.select("place", "name", "digest").join(outer.drop("subroot", "tree"), "place")
    outer = cut(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root", "before", "after"))
    for nodes in reversed(rounds[1:-1]):
        outer = cut(_down(nodes, outer, levels))
    out = _prove(leaves, outer, levels).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
