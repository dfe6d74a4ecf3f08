"""Benchmark decontamination by templates.

Texts become templates: numbers, names and units are placeholders, of which equal neighbours
are one, and other words stay. Windows of templates are hash-joined. What fills the
placeholders (slots) must agree on a diagonal, that is for one shift between item and
document: each value of the item stands for one value of the document, the one most of its windows have there, and
windows with another value don't count. So a question with other numbers or names is found as well, and a chance likeness isn't.
Items without a window of enough plain words (short questions, formulas, lists of numbers) are asked for by runs of their words as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.llm.bitmap import broadcast_bitmap, may_be_in
from holdlens.llm.cluster import cut
from holdlens.llm.words import ALNUM, mix, steps, words

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
NUMBER, NAME, UNIT = U(11), U(12), U(13)
#: Bits of the bitmap that tells which windows any item may have; 2 MB at any benchmark size.
BITMAP_BITS = 1 << 24
#: Words that an item must have to be looked for.
LEAST_ITEM_WORDS = 3

_NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
_UNIT_WORDS = (
    "m km cm mm mile miles meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet ft yard yards "
    "g kg mg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes "
    "s second seconds minute minutes min h hour hours day days week weeks month months year years "
    "l ml liter liters litre litres gallon gallons cup cups percent degrees degree celsius fahrenheit kelvin "
    "dollar dollars euro euros cent cents usd eur gbp watt watts kw kwh volt volts joule joules hz mph kmh"
)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    return np.sort(words(data, np.array([0, len(data)]), ALNUM).hash)


_NUMBERS, _UNITS = _hashes(_NUMBER_WORDS), _hashes(_UNIT_WORDS)


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _templates(texts: pa.Array):
    """For each step: first row, tokens, slot values (0: a word that stays) and rows' first tokens."""
    for a, _, data, offsets in steps(texts):
        w = words(data, offsets, ALNUM)
        n = len(w.hash)
        if not n:
            yield a, w.hash, w.hash, w.rows
            continue
        first, second = data[w.start], data[np.minimum(w.start + 1, len(data) - 1)]
        opens = np.zeros(n, bool)
        opens[w.rows[:-1][w.rows[:-1] < n]] = True
        ends = np.cumsum((data == 10) | (data == 46) | (data == 33) | (data == 63))
        opens[1:] |= ends[w.start[1:]] != ends[w.end[:-1]  - 1]
        number = ((first >= 48) & (first <= 57)) | _among(w.hash, _NUMBERS)
        unit = _among(w.hash, _UNITS)
        unit[1:] &= number[:-1]
        unit[0] = False
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        name = capital & ~opens & ~number & ~unit
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, U(0))))
        token = np.where(kind > 0, kind, w.hash)
        fresh = np.ones(n, bool)
        fresh[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1])
        fresh[w.rows[:-1][w.rows[:-1] < n]] = True
        at = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        value = np.add.reduceat(mix(w.hash + place.astype(np.uint64) * _P), at)
        kind = kind[at]
        yield a, token[at], np.where(kind > 0, value | U(1), U(0)), np.searchsorted(at, w.rows)


def _windows(texts: pa.Array, n: int, least_words: int):
    """(row, place, hash, slots) of the windows of ``n`` tokens, of which at least ``least_words`` aren't placeholders."""
    for a, token, slot, rows in _templates(texts):
        width = len(token) - n + 1
        if width < 1:
            continue
        h = np.zeros(width, np.uint64)
        plain = np.zeros(width, np.int8)
        for j in range(n):
            h = mix(h * _P + token[j : j + width])
            plain += slot[j : j + width] == 0
        row = np.searchsorted(rows, np.arange(width), side="right") - 1
        ok = np.flatnonzero((plain >= least_words) & (np.arange(width) + n <= rows[row + 1]))
        yield a, row[ok] + a, ok - rows[row[ok]], h[ok].view(np.int64), slot, ok


def _runs(texts: pa.Array, sizes: list[int]):
    """(size, row, place, hash) of all runs of ``sizes`` words as they are, but for A-Z."""
    for a, _, data, offsets in steps(texts):
        w = words(data, offsets, ALNUM)
        for size in sizes:
            width = len(w.hash) - size + 1
            if width < 1:
                continue
            h = np.full(width, 1000 + size, np.uint64)  # apart from the templates' hashes
            for j in range(size):
                h = mix(h * _P + w.hash[j : j + width])
            row = np.searchsorted(w.rows, np.arange(width), side="right") - 1
            ok = np.flatnonzero(np.arange(width) + size <= w.rows[row + 1])
            yield size, row[ok] + a, ok - w.rows[row[ok]], h[ok].view(np.int64)


def _keyed(table: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return table.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _batch(batch, row, place, window, slots) -> pa.RecordBatch:
    rows = pa.array(row)
    return pa.record_batch([batch.column("key").take(rows), batch.column("text_hash").take(rows), pa.array(place, pa.int64()), pa.array(window), slots], ["key", "text_hash", "place", "window", "slots"])


_WINDOWS = "key long, text_hash long, place long, window long, slots array<long>"


def _item_windows(benchmark: DataFrame, n: int, least_words: int, exact_words: int) -> DataFrame:
    """``(key, text_hash, place, window, slots, size)``: template windows (size 0), or runs of size words for items without one."""

    def run(batches):
        for batch in batches:
            has = np.zeros(batch.num_rows, bool)
            for _, row, place, window, slot, at in _windows(batch.column("text"), n, least_words):
                has[row] = True
                yield _with_size(_batch(batch, row, place, window, _slots(slot, at, n)), 0)
            for size in range(LEAST_ITEM_WORDS, exact_words + 1):
                for _, row, place, window in _runs(batch.column("text"), [size]):
                    n_words = np.bincount(row, minlength=batch.num_rows) + size - 1
                    mine = ~has[row] & ((size == exact_words) | (n_words[row] == size))
                    yield _with_size(_batch(batch, row[mine], place[mine], window[mine], _no_slots(int(mine.sum()))), size)

    return _keyed(benchmark, "item_id").mapInArrow(run, f"{_WINDOWS}, size int")


def _with_size(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    return pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, size, np.int32))], [*batch.schema.names, "size"])


def _slots(slot: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    values = np.stack([slot[at + j] for j in range(n)], 1).view(np.int64).ravel()
    return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, n, dtype=np.int32), pa.array(values))


def _no_slots(n: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.zeros(n + 1, np.int32), pa.array([], pa.int64()))


def _document_windows(docs: DataFrame, n: int, least_words: int, sizes: list[int], wanted) -> DataFrame:
    """``(key, text_hash, place, window, slots)`` of the windows that some item may have, by the bitmap ``wanted``."""

    def run(batches):
        for batch in batches:
            for _, row, place, window, slot, at in _windows(batch.column("text"), n, least_words):
                hit = np.flatnonzero(may_be_in(wanted.value, window))
                if len(hit):
                    yield _batch(batch, row[hit], place[hit], window[hit], _slots(slot, at[hit], n))
            for _, row, place, window in _runs(batch.column("text"), sizes) if sizes else ():
                hit = np.flatnonzero(may_be_in(wanted.value, window))
                if len(hit):
                    yield _batch(batch, row[hit], place[hit], window[hit], _no_slots(len(hit)))

    return _keyed(docs, "doc_id").mapInArrow(run, _WINDOWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 5, least_words: int = 3, exact_words: int = 8, coverage: float = 0.5) -> DataFrame:
    """``(doc_id, text_hash, item_id, windows, item_windows, coverage, verbatim)`` of documents and items they hold.

    windows: the item's windows of ``n`` template tokens, ``least_words`` of them plain words, that the document has with agreeing slots;
    reported from ``coverage`` of the item's windows on. An item without such a window is asked for by runs of ``exact_words``
    words, or of all its words if it has fewer. verbatim: all slots are equal as
    well. Null texts and items of fewer than LEAST_ITEM_WORDS words match nothing; a null id is reported as null.
    Equal rows are one document; items with one id, also a null one, are one item.
    """
    items = cut(_item_windows(benchmark, n, least_words, exact_words))
    exact = [r.size for r in items.where("size > 0").select("size").distinct().orderBy("size").collect()]  # exact_words values at most
    sizes = items.select("key", "window").distinct().groupBy(F.col("key").alias("sized")).agg(F.count(F.lit(1)).alias("item_windows"))
    found = _document_windows(docs, n, least_words, exact, broadcast_bitmap(items, "window", BITMAP_BITS)).distinct()
    asked = items.select(F.col("key").alias("item_id"), "window", F.col("text_hash").alias("item_text"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots")).distinct()
    filled = F.expr("filter(arrays_zip(item_slots, slots), x -> x.item_slots != 0)")
    group = ["key", "text_hash", "item_id"]
    diagonal = [*group, "item_text", "shift"]
    pairs = found.join(asked, "window").select(*group, "item_text", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "window", filled.alias("filled"))
    each = pairs.select(*diagonal, "item_place", "window", F.size("filled").alias("n_slots"), F.explode_outer("filled").alias("x")).select("*", "x.item_slots", "x.slots").drop("x")
    value = Window.partitionBy(*diagonal, "item_slots")
    each = each.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*diagonal, "item_slots", "slots")))
    each = each.withColumn("chosen", F.first("slots").over(value.orderBy(F.col("votes").desc(), "slots")))
    agrees, equal = F.col("slots") == F.col("chosen"), F.col("slots") == F.col("item_slots")
    agreeing = each.groupBy(*diagonal, "item_place", "window", "n_slots").agg(F.count_if(agrees).alias("agreeing"), F.count_if(equal).alias("equal")).where("agreeing = n_slots")
    sums = agreeing.groupBy(*group).agg(F.count_distinct("window").alias("windows"), F.min(F.col("equal") == F.col("n_slots")).alias("verbatim")).join(sizes, F.col("item_id").eqNullSafe(F.col("sized")))
    share = F.col("windows") / F.col("item_windows")
    return sums.where(share >= coverage).select(F.col("key").alias("doc_id"), "text_hash", "item_id", "windows", "item_windows", share.alias("coverage"), "verbatim")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without rows that hold an item; columns, whatever their names, and other rows stay."""
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("no_id"))
    bad = cut(contaminated(docs, benchmark, **options).select(*key(F.col("doc_id")), "text_hash").distinct())
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key(F.col("doc_id").cast("long")), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return keyed.join(bad, ["id", "no_id", "text_hash"], "left_anti").select("row.*")
