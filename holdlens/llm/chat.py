"""Chat formatting of typed content parts.

A turn has a role and parts of the types text, image, audio and document. A visitor flattens them in
order: text is escaped, others become placeholders that name type and place. Attachments
are recorded with the tokens that their placeholder stands for. A conversation's text is ``BEGIN``
and its turns' segments in order. What looks like a control string in a text, and each
backslash, gets a backslash before it, so a reader can tell and restores all texts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
#: What stands before and after a turn's content.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
ROLE, END_ROLE, END_TURN = "[ROLE]", "[/ROLE]", "[/TURN]"
_ESCAPED = r"(\\|</?s>|<</?SYS>>|\[/?(?:INST|OUT|ROLE|TURN)\]|<\|)"
_READ = re.compile(r"\\(.)|(</?s>|<</?SYS>>|\[/?(?:INST|OUT|ROLE|TURN)\])|<\|(\w+):(\d+)\|>|[^\\<\[]+|.", re.DOTALL)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Characters a text token, pixels a side of an image token, audio tokens a second, tokens a page.
CHARS_PER_TOKEN, PATCH, AUDIO_RATE, PAGE_TOKENS = 4, 28, 25, 800


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"\\$1")


def _visit(part: Column, place: Column) -> Column:
    """(shown, is_text, type, ref, tokens) of a part; an unknown type counts as document, a null one as text."""
    kind = F.coalesce(F.lower(part["type"]), F.lit("text"))
    kind = F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise("document")
    text = F.coalesce(part["text"], F.lit(""))
    side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / PATCH)
    tokens = (
        F.when(kind == "text", F.ceil(F.length(text) / CHARS_PER_TOKEN))
        .when(kind == "image", F.greatest(F.lit(1), side(part["width"]) * side(part["height"])))
        .when(kind == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)))
        .otherwise(F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS))
    )
    shown = F.when(kind == "text", escape(text)).otherwise(F.format_string("<|%s:%d|>", kind, place))
    return F.struct(shown.alias("shown"), (kind == "text").alias("is_text"), kind.alias("type"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"), place.cast("int").alias("place"))


def text_part(text: Column) -> Column:
    """One text part as an array of parts."""
    nothing = {f: F.lit(None) for f in ("ref", "width", "height", "seconds", "pages")}
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *(c.alias(n) for n, c in nothing.items()))).cast(f"array<{PART}>")


def format_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, segment, loss, loss_start, loss_end, attachments, tokens)`` of ``turns(conv_id, turn, role, parts)``.

    loss: whether the turn is the assistant's; its content is segment[loss_start:loss_end] in code points, escaped.
    A null role is empty; roles other than system, user and assistant are written out. Null parts: no content.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    seen = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p, i: _visit(p, i))
    body = F.concat_ws("", F.transform("seen", lambda x: x["shown"]))
    opening, closing = F.concat(F.lit(ROLE), escape(role), F.lit(END_ROLE)), F.lit(END_TURN)
    for name, (a, b) in MARKS.items():
        opening, closing = F.when(role == name, a).otherwise(opening), F.when(role == name, b).otherwise(closing)
    out = turns.select("conv_id", "turn", role.alias("role"), seen.alias("seen")).select("*", body.alias("body"), opening.alias("opening"), closing.alias("closing"))
    start = F.length("opening")
    attached = F.transform(F.filter("seen", lambda x: ~x["is_text"]), lambda x: F.struct(x["place"].alias("place"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return out.select(
        "conv_id", "turn", "role", F.concat("opening", "body", "closing").alias("segment"), (F.col("role") == "assistant").alias("loss"),
        start.alias("loss_start"), (start + F.length("body")).alias("loss_end"), attached.alias("attachments"),
        F.coalesce(F.aggregate("seen", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]), F.lit(0)).cast("long").alias("tokens"),
    )


def read_segment(segment: str) -> tuple[str, str]:
    """Role and unescaped content of a segment."""
    content: list[str] = []
    role, in_role = None, False
    for m in _READ.finditer(segment):
        mark = m[2]
        if mark is None:
            content.append(m[1] if m[1] is not None else m[0])
        elif mark == ROLE:
            in_role = True
        elif mark == END_ROLE and in_role:
            role, content, in_role = "".join(content), [], False
        elif role is None:
            role = next(r for r, (a, _) in MARKS.items() if a == mark)
        elif mark != (MARKS[role][1] if role in MARKS else END_TURN):
            raise ValueError(f"{mark} inside a turn of {role!r}")
    return role or "", "".join(content)


def read_conversations(segments: DataFrame) -> DataFrame:
    """Digests of the conversations, read back from ``format_turns``'s segments.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, tokens, n_attachments)``. A task sorts its
    conversations by (turn, role, segment) and reads them one turn after another, so a long one takes no more memory
    than a turn. Null ids are one conversation.
    """

    def run(batches):
        state = None
        for batch in batches:
            done = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "loss_start", "loss_end", "tokens", "n_attached")), strict=True)
            for conv, segment, loss, a, b, tokens, attached in rows:
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_finish(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN), 0, 0]
                role, text = read_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    learned = "".join(m[1] if m[1] is not None else m[0] for m in _READ.finditer(segment[a:b]))
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
                state[6] += tokens
                state[7] += attached
            if done:
                yield rows_of(done)
        if state is not None:
            yield rows_of([_finish(state)])

    def rows_of(done):
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "tokens", "n_attachments"]
    rows = segments.select(F.col("conv_id").cast("long"), "turn", "role", "segment", "loss", "loss_start", "loss_end", "tokens", F.size("attachments").alias("n_attached"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment").select("conv_id", "segment", "loss", "loss_start", "loss_end", "tokens", "n_attached")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, tokens long, n_attachments long")


def _finish(s: list) -> tuple:
    return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7])
