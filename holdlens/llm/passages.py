"""Removal of repeated lines and passages by hashing normalised units.

A unit is a stretch of a line that begins at the line's start, after a sentence's
end, or where a capital follows a word without one. Where there is no such mark for
``QUIET`` words, one also begins where the hash of the last three words is the least nearby, so the units of a
passage are the same wherever it was put. Text without spaces is cut after its full-width stops. A unit's digest is that of its words (runs without ASCII
white space, A-Z as a-z), so spacing and ASCII case don't matter. Whole lines of several
units have a digest as well. Digests are grouped over all documents; the occurrence with the
smallest (doc_id, text hash, place) stays. All later whole lines go, and pieces of lines
where repeats that stand side by side have ``least_words`` words or more: short stock phrases inside lines stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdlens.llm.bitmap import broadcast_bitmap, may_be_in
from holdlens.llm.cluster import cut
from holdlens.llm.words import SPACED, mix, steps, words

U = np.uint64
#: Words without a mark after which hashes cut: where one is the least of those up to REACH words away.
QUIET, REACH = 12, 4
#: Bounds for ``remove_repeats`` under which short stock lines ("Thanks.") of otherwise clean documents stay.
KEEP_STOCK_LINES = {"line_words": 4, "line_bytes": 24}
#: Bits of the bitmap of repeated digests: 16 MB at any number of them.
BITMAP_BITS = 1 << 27
_P = U(0x9E3779B97F4A7C15)
#: By code point below 0x10000: capitals, ends of sentences, what may follow these, and stops that end a word of text without spaces.
_POINTS = range(0x10000)
_CAPITAL = np.fromiter((chr(i).isupper() for i in _POINTS), bool)
_ENDS, _CLOSES, _WIDE = (np.isin(_POINTS, [ord(c) for c in x]) for x in (".!?\n\u2026\u037e\u0589\u061f\u06d4\u0964\u0965\u1362\u3002\uff01\uff0e\uff1f\uff61", "\"')]}*\u00bb\u2019\u201d\u203a\u300d\u300f\uff09", "\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61"))


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of up to three bytes that begin at ``at``; 0 for longer ones."""
    a, b, c = (data[np.minimum(at + k, len(data) - 1)].astype(np.int32) for k in range(3))
    return np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, 0)))


def _last_points(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point before each ``end``, and where it begins."""
    at = end - 1
    for _ in range(3):
        at = at - ((data[at] & 0xC0) == 0x80)
    return _points(data, at), at


def _wide_stops(data: np.ndarray) -> np.ndarray:
    """The bytes after full-width stops."""
    at = np.flatnonzero((data == 0xE3) | (data == 0xEF))
    return at[_WIDE[_points(data, at)]] + 3 if len(at) else at


def _unit_starts(data: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a step begin a unit, and which a line."""
    n = len(w.start)
    out, begins = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return out, begins
    begins[w.rows[:-1][w.rows[:-1] < n]] = True
    capital = _CAPITAL[_points(data, w.start)]
    last, at = _last_points(data, w.end)
    for _ in range(2):  # quotes and brackets after a stop
        inner = _CLOSES[last] & (at > w.start)
        before, where = _last_points(data, np.maximum(at, 1))
        last, at = np.where(inner, before, last), np.where(inner, where, at)
    out[1:] |= _ENDS[last[:-1]] | _WIDE[last[:-1]] | (capital[1:] & ~capital[:-1])
    lines = np.cumsum(data == 10)
    begins[1:] |= lines[w.start[1:]] != lines[w.end[:-1] - 1]
    out |= begins
    # what hashes say depends on the words nearby alone, and on marks among the last QUIET ones
    place = np.arange(n)
    quiet = place - np.maximum.accumulate(np.where(out, place, 0)) >= QUIET
    # none so near a line's end that the next line, or row of the step, has a say
    line = np.flatnonzero(begins)
    quiet &= np.append(line, n)[np.searchsorted(line, place, side="right")] - place > REACH
    three = np.zeros(n, np.uint64)
    for j in (3, 2, 1):
        three[3:] = mix(three[3:] * _P + w.hash[3 - j : n - j])
    padded = np.pad(three, REACH, constant_values=U(2**64 - 1))
    least = np.lib.stride_tricks.sliding_window_view(padded, 2 * REACH + 1).min(1)
    return out | (quiet & (three == least)), begins


def _digest(h: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of runs of words, 64 and 32 bits."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    place = np.arange(len(h)) - np.repeat(starts, size)
    spread, n = h + place.astype(np.uint64) * U(0x9E3779B97F4A7C15), size.astype(np.uint64)
    low, high = (mix(np.add.reduceat(mix(spread ^ salt), starts) + n).view(np.int64) for salt in (U(0), U(0xA5A5A5A5A5A5A5A5)))
    return low, high.astype(np.int32)


@dataclass
class Units:
    """The units of a text and its lines; the digests of lines of several units follow those of the units."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray  #: first unit of each line, and the number of units
    digest: np.ndarray  #: where each line's digest is


def _units(texts: pa.Array):
    """The Units of each text."""
    for a, b, data, offsets in steps(texts):
        w = words(data, offsets, SPACED, _wide_stops(data))
        is_start, begins = _unit_starts(data, w)
        starts, lines = np.flatnonzero(is_start), np.flatnonzero(begins)
        size, long = np.diff(np.append(starts, len(w.start))), np.diff(np.append(lines, len(w.start)))
        first, last = w.start[starts], w.end[starts + size - 1]
        low, high = _digest(w.hash, starts, size)
        line_low, line_high = _digest(w.hash, lines, long)
        unit_of = np.searchsorted(starts, lines)
        several = np.diff(np.append(unit_of, len(starts))) > 1
        rows, line_rows = np.searchsorted(starts, w.rows), np.searchsorted(lines, w.rows)
        for i in range(b - a):
            s, t = slice(rows[i], rows[i + 1]), slice(line_rows[i], line_rows[i + 1])
            many, of, n = several[t], unit_of[t] - rows[i], rows[i + 1] - rows[i]
            digest = np.where(many, n + np.cumsum(many) - 1, of)
            yield Units(np.append(low[s], line_low[t][many]), np.append(high[s], line_high[t][many]), size[s], first[s] - offsets[i], last[s] - offsets[i], np.append(of, n), digest)


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = list(_units(batch.column("text")))
            if found:
                low, high = (pa.array([getattr(x, k) for x in found], pa.list_(kind)) for k, kind in (("low", pa.int64()), ("high", pa.int32())))
                yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), low, high], ["doc_id", "text_hash", "low", "high"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, low array<long>, high array<int>")


def _repeated_places(known: DataFrame) -> DataFrame:
    """``(id, hash, places)``: the units of a text, by place, that an earlier one has.

    Digests are counted first. A bitmap of those that occur twice lets few others through, so only repeats are moved with
    where they are; the earliest places are written, so that a digest with very many places can be split in the join.
    """
    often = known.select(F.explode("low").alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = broadcast_bitmap(often, "low", BITMAP_BITS)

    def run(batches):
        for batch in batches:
            low, high = (batch.column(c) for c in ("low", "high"))
            digests = low.flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(may_be_in(wanted.value, digests))
            if not len(hit):
                continue
            first = low.offsets.to_numpy().astype(np.int64) - low.offsets[0].as_py()
            row = np.searchsorted(first, hit, side="right") - 1
            rows, at = pa.array(row), pa.array(hit)
            yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array((hit - first[row]).astype(np.int32)), low.flatten().take(at), high.flatten().take(at)], ["doc_id", "text_hash", "place", "low", "high"])

    units = known.mapInArrow(run, "doc_id long, text_hash long, place int, low long, high int")
    groups = units.groupBy("low", "high").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = cut(groups.where("n > 1").select("low", "high", "first"))
    repeats = units.join(first, ["low", "high"]).where("not (struct(doc_id, text_hash, place) <=> first)")
    return repeats.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("place").alias("places"))


def _edges(mark: np.ndarray) -> list[tuple[int, int]]:
    """First unit and unit after the last of each run of marked ones."""
    edge = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2], edge[1::2], strict=True))


def _runs(repeat: np.ndarray, u: Units, least_words: int, line_words: int, line_bytes: int) -> list[tuple[int, int]]:
    """First unit and unit after the last of each run that goes."""
    n = len(u.size)
    gone = np.zeros(n, bool)
    for s, e, d in zip(u.line[:-1], u.line[1:], u.digest, strict=True) if repeat.any() else ():
        if repeat[d] and (u.size[s:e].sum() >= line_words or u.end[e - 1] - u.start[s] >= line_bytes):
            gone[s:e] = True
    for s, e in _edges(repeat[:n] | gone):
        if u.size[s:e].sum() >= least_words or u.end[e - 1] - u.start[s] >= 10 * least_words:
            gone[s:e] = True
    return _edges(gone)


def remove_repeats(docs: DataFrame, *, least_words: int = 25, line_words: int = 1, line_bytes: int = 1) -> DataFrame:
    """All columns of ``docs`` with the text cut, and ``n_units``, ``n_removed``, ``n_spans``, ``removed``, ``kept``.

    Every repeated line goes, with other bounds those of ``line_words`` words or ``line_bytes`` bytes; repeats inside lines from ``least_words`` words or ten times as many bytes on.
    removed, kept: arrays of (start, end) in bytes of the original text as UTF-8, in order; together they
    cover it. No row is dropped. A null text stays null with no spans, an empty one
    stays empty. Rows that share doc_id and text are one document; null ids rank first.
    Columns that bear the added names are replaced; any other name may occur.
    """
    added = ["n_units", "n_removed", "n_spans", "removed", "kept"]
    names = [c for c in docs.columns if c not in added]
    others = [F.col(f"`{c}`") for c in names if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    places = _repeated_places(cut(_digests(keyed.select("doc_id", "text_hash", "text"))))
    joined = keyed.join(places, keyed["doc_id"].eqNullSafe(places["id"]) & (keyed["text_hash"] == places["hash"]), "left").select("row", "text", "places")

    def run(batches):
        for batch in batches:
            texts, found = batch.column("text").cast(pa.string()), batch.column("places")
            out = [[] for _ in range(6)]
            for i, u in enumerate(_units(texts)):
                data = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else None
                n, start, repeat = len(u.size), u.start, np.zeros(len(u.low), bool)
                if found[i].is_valid:
                    repeat[found[i].values.to_numpy(zero_copy_only=False)] = True
                gone = _runs(repeat, u, least_words, line_words, line_bytes)
                removed = [(int(start[s]), int(start[e]) if e < n else len(data)) for s, e in gone]
                marks = [0, *(x for r in removed for x in r), len(data or b"")]
                kept = [(s, e) for s, e in list(pairwise(marks))[::2] if s < e]
                new = None if data is None else data if not removed else b"".join(data[s:e] for s, e in kept)
                for x, y in zip(out, (new, n, sum(int(e - s) for s, e in gone), len(removed), removed, kept), strict=True):
                    x.append(y)
            if not out[0]:
                continue
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            spans = [pa.array([[{"start": s, "end": e} for s, e in x] for x in y], span) for y in out[4:]]
            yield pa.record_batch([batch.column("row"), pa.array(out[0], pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in out[1:4]), *spans], ["row", "text", *added])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [T.LongType()] * 3 + [span] * 2
    made = joined.mapInArrow(run, T.StructType([*joined.schema.fields[:2], *(T.StructField(c, k) for c, k in zip(added, kinds, strict=True))]))
    return made.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names), *added)
