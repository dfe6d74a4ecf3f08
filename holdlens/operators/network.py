"""The common-ownership graph of each month: two stocks are tied by the managers that hold both.

``g_ij`` is the sum over managers of ``w_i * w_j``. Weighted degree and peer pressure need no pairs: for a
manager with S the sum of its weights, stock i's ties through it are ``w_i * (S - w_i)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import month_text, require_columns
from holdlens.sources.shared import small, spread, written


def _held(positions: DataFrame, phi: Column | None = None) -> DataFrame:
    """Positions with a positive weight; ``phi`` weighs managers."""
    w = F.col("portfolio_weight") * (F.sqrt(phi) if phi is not None else F.lit(1.0))
    return require_columns(positions, ["month", "manager_id", "permno", "portfolio_weight"]).select("month", "manager_id", "permno", w.alias("w")).where("w > 0")


def manager_phi(positions: DataFrame) -> DataFrame:
    """``(month_date, manager_id, phi)``: how much of its weights a manager passes on, from what it did in the month before.

    phi = (1 + turnover) * (1 + concentration), where turnover is half the sum of the changes of weights and concentration the sum of their
    squares, both of the month before, so that no later month is seen. 1 where the manager had no position then. A first month has no turnover.
    """
    # a manager is placed once; all that follows stays there
    w = spread(positions.select("month_date", "manager_id", "permno", F.col("portfolio_weight").alias("w")).where("w > 0"), "manager_id", rows=positions.count())
    w = w.groupBy("manager_id", "permno", "month_date").agg(F.sum("w").alias("w"))
    stock = Window.partitionBy("manager_id", "permno").orderBy("month_date")
    follows = lambda along: F.add_months(F.lag("month_date").over(along), 1) == F.col("month_date")
    left = F.lead("month_date").over(stock).isNull() | (F.lead("month_date").over(stock) != F.add_months("month_date", 1))
    w = w.withColumns({"then": F.when(follows(stock), F.lag("w").over(stock)).otherwise(0.0), "gone": F.when(left, F.col("w")).otherwise(0.0)})
    whole = w.groupBy("manager_id", "month_date").agg(F.sum(F.abs(F.col("w") - F.col("then"))).alias("moved"), F.sum("w").alias("now"), F.sum("gone").alias("gone"), F.sum(F.col("w") * F.col("w")).alias("concentration"))
    months = Window.partitionBy("manager_id").orderBy("month_date")
    # what a manager gave up entirely has moved in the month after
    turnover = F.when(follows(months), (F.col("moved") + F.lag("gone").over(months)) / 2).otherwise(0.0)
    whole = whole.withColumn("own", (1 + turnover) * (1 + F.col("concentration")))
    return whole.select("month_date", "manager_id", F.when(follows(months), F.lag("own").over(months)).otherwise(1.0).alias("phi"))


def with_phi(positions: DataFrame) -> DataFrame:
    """``positions`` with ``phi``, for the ``phi`` of the functions below."""
    phi = manager_phi(positions).select(month_text(F.col("month_date")).alias("month"), "manager_id", "phi")
    placed = spread(positions, "month", "manager_id", rows=positions.count())  # by the keys of the books below
    return placed.join(phi, ["month", "manager_id"])


def common_ownership_edges(positions: DataFrame, *, phi: Column | None = None) -> DataFrame:
    """``(month, i, j, g)`` with i < j.

    The pairs of a manager's month are what the result sums up, so this is for small months; ``top_edges`` and the degrees below need fewer, or none.
    """
    p = _held(positions, phi)
    a, b = p.withColumnsRenamed({"permno": "i", "w": "wi"}), p.withColumnsRenamed({"permno": "j", "w": "wj"})
    return a.join(b, ["month", "manager_id"]).where("i < j").groupBy("month", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("g"))


#: Heaviest edges of a month, stocks of a block, and decimals within which two weights tie.
TOP_EDGES, BLOCK, TIE_DECIMALS = 2500, 64, 12
#: A month of fewer blocks than so many times those of the bound is paired whole.
FEW_HEADS = 4


def _pair_sums(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(month, i, j, g)`` of all stocks in ``pairs(month, a, b)`` of blocks, a <= b; i comes from the block a, which has larger norms."""
    left = held.join(pairs, (held["month"] == pairs["month"]) & (held["block"] == pairs["a"])).select(held["month"], "manager_id", F.col("place").alias("pi"), F.col("permno").alias("pa"), F.col("w").alias("wi"), "b")
    right = held.select("month", "manager_id", F.col("place").alias("pj"), F.col("permno").alias("pb"), F.col("w").alias("wj"), F.col("block").alias("b"))
    both = left.join(right, ["month", "manager_id", "b"]).where("pi < pj")
    return both.groupBy("month", F.least("pa", "pb").alias("i"), F.greatest("pa", "pb").alias("j")).agg(F.sum(F.col("wi") * F.col("wj")).alias("g"))


def _ranked(edges: DataFrame, top_k: int) -> DataFrame:
    w = Window.partitionBy("month").orderBy(F.round("g", TIE_DECIMALS).desc(), "i", "j")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def block_pairs(positions: DataFrame, *, top_k: int = TOP_EDGES, block: int = BLOCK, phi: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``held``: positions with their stock's place and block by norm, and ``pairs(month, a, b)``: the blocks that may hold one of the heaviest edges.

    A stock is the vector of its weights over a month's managers, an edge's weight a dot product, so at most the product of two norms. The
    stocks of largest norms, as few as have ``top_k`` pairs, are paired first; the ``top_k``-th of their weights is a bound from
    below, and block pairs whose largest product of norms is less can't hold a heavier edge.
    """
    p = _held(positions, phi)
    if phi is not None:  # read twice
        p = written(p, "weighed")
    norms = p.groupBy("month", "permno").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    placed = norms.withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(F.col("norm").desc(), "permno")) - 1)
    placed = written(placed.withColumn("block", F.floor(F.col("place") / block).cast("int")), "placed")  # tables, so that their size is known: small ones are broadcast
    held = written(p.join(placed.select("month", "permno", "place", "block"), ["month", "permno"]), "held")
    blocks = placed.groupBy("month", "block").agg(F.max("norm").alias("norm"))
    first = -(-int((1 + math.sqrt(1 + 8 * top_k)) / 2 + 1) // block)  # blocks whose stocks have top_k pairs
    of = lambda name: blocks.select("month", F.col("block").alias(name), F.col("norm").alias(f"n{name}"))
    all_pairs = of("a").join(of("b"), "month").where("a <= b")
    # where the first blocks are a large part of a month, a bound saves less than it costs
    wide = blocks.groupBy("month").agg(F.max("block").alias("last")).where(F.col("last") >= FEW_HEADS * first).select("month")
    if wide.isEmpty():
        return held, written(all_pairs.select("month", "a", "b"), "block-pairs")
    head = _ranked(_pair_sums(held, all_pairs.join(wide, "month", "left_semi").where(F.col("b") < first).select("month", "a", "b")), top_k)
    least = head.groupBy("month").agg(F.max(F.when(F.col("rank") == top_k, F.col("g"))).alias("least"))
    # sums may differ in their last digits, and weights that tie with the bound stay
    slack = 10.0**-TIE_DECIMALS
    pairs = all_pairs.join(least, "month", "left").where(F.col("na") * F.col("nb") * (1 + slack) + slack >= F.coalesce("least", F.lit(0.0)))
    return held, written(pairs.select("month", "a", "b"), "block-pairs")


def top_edges(positions: DataFrame, *, top_k: int = TOP_EDGES, block: int = BLOCK, phi: Column | None = None) -> DataFrame:
    """``(month, i, j, g, rank)``, i < j: each month's ``top_k`` heaviest edges; weights within ``TIE_DECIMALS`` tie and go by i and j."""
    return _ranked(_pair_sums(*block_pairs(positions, top_k=top_k, block=block, phi=phi)), top_k)


#: Cells of a matrix of weights at most, and parts of a month whose pairs are summed up apart.
CELLS, HANDS = 1 << 22, 16


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and their rows."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))


def _cuts(batches: Iterator[pa.RecordBatch], stocks: int) -> Iterator[pa.RecordBatch]:
    """Batches whose rows by ``stocks`` are ``CELLS`` at most."""
    step = max(1, CELLS // stocks)
    return (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step))


def _matrix(values: np.ndarray, rows: np.ndarray, n: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[rows, n] = values
    return out


def folio_weights(folios: DataFrame, numbers: DataFrame, *, lagged: bool) -> DataFrame:
    """``(month_date, hand, phi, n, w)``, a row for each row of ``ownership.folios``: its stocks' numbers and weights, and, where ``lagged``, phi as in ``manager_phi``, else 1.

    A manager's months follow each other, so a month's weights meet those of the one before in the next row; ``hand`` is one of ``HANDS`` for a manager.
    """
    hand = F.pmod(F.xxhash64("manager_id"), F.lit(HANDS)).cast("int").alias("hand")
    months = Window.partitionBy("manager_id").orderBy("month_date")
    follows = F.coalesce(F.add_months(F.lag("month_date").over(months), 1) == F.col("month_date"), F.lit(False)) if lagged else F.lit(False)
    w = F.transform("held", lambda x: x["position_value_proxy"] / F.col("manager_total_value_proxy"))
    rows = folios.select("month_date", hand, follows.alias("follows"), F.col("held.n").alias("n"), w.alias("w"))
    if not lagged:
        return rows.select("month_date", "hand", F.lit(1.0).alias("phi"), "n", "w")
    stocks = max(1, numbers.count())

    def phis(batches):
        last, own = np.zeros((1, stocks)), np.ones(1)
        for b in _cuts(batches, stocks):
            (values, of), n = _lists(b.column("w")), b.column("n").flatten().to_numpy(zero_copy_only=False)
            now, after = _matrix(values, of, n, (b.num_rows, stocks)), b.column("follows").to_numpy(zero_copy_only=False)
            turnover = np.where(after, np.abs(np.diff(now, axis=0, prepend=last)).sum(1) / 2, 0.0)
            owns = (1 + turnover) * (1 + (now * now).sum(1))
            phi = np.where(after, np.concatenate([own, owns[:-1]]), 1.0)
            last, own = now[-1:], owns[-1:]
            yield pa.RecordBatch.from_arrays([b.column("month_date"), b.column("hand"), pa.array(phi), b.column("n"), b.column("w")], ["month_date", "hand", "phi", "n", "w"])

    return rows.mapInArrow(phis, "month_date date, hand int, phi double, n array<int>, w array<double>")


def folio_edges(folios: DataFrame, numbers: DataFrame, *, lagged: bool = False, rows: int = 0) -> DataFrame:
    """``(month, i, j, g)``, i < j, of stocks with a positive weight in common, as ``common_ownership_edges``, from ``ownership.folios`` with its ``numbers``; ``lagged``: phi of ``manager_phi`` weighs managers.

    A book's weights are a row of a matrix, and a month's edges the product of that matrix with itself. Books are dealt by month and hand and added up one month after the
    other, so no pair of a book is shuffled, a task keeps one month's square, and what it passes on doesn't grow with managers. ``rows``: see ``spread``.
    """
    stocks = max(1, numbers.count())

    def squares(batches):
        month, g, met = None, None, None

        def made():
            i, j = np.nonzero(np.triu(met, 1))
            return pa.RecordBatch.from_arrays([pa.array([month] * len(i), pa.date32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], ["month_date", "a", "b", "g"])

        for b in _cuts(batches, stocks):
            days = b.column("month_date").cast(pa.int32()).to_numpy(zero_copy_only=False)
            (values, of), n, phi = _lists(b.column("w")), b.column("n").flatten().to_numpy(zero_copy_only=False), b.column("phi").to_numpy(zero_copy_only=False)
            now = _matrix(values, of, n, (b.num_rows, stocks))
            starts = np.flatnonzero(np.diff(days, prepend=days[:1] - 1))
            for first, after in zip(starts, [*starts[1:], len(days)]):
                w, day = now[first:after], b.column("month_date")[int(first)].as_py()
                if day != month:
                    if month is not None:
                        yield made()
                    month, g, met = day, np.zeros((stocks, stocks)), np.zeros((stocks, stocks))
                g += (w * phi[first:after, None]).T @ w
                held = (w > 0).astype(float)
                met += held.T @ held
        if month is not None:
            yield made()

    dealt = spread(folio_weights(folios, numbers, lagged=lagged), "month_date", "hand", rows=rows).sortWithinPartitions("month_date")
    sums = dealt.mapInArrow(squares, "month_date date, a int, b int, g double").groupBy("month_date", "a", "b").agg(F.sum("g").alias("g"))
    of = lambda k, name: numbers.select(F.col("n").alias(k), F.col("permno").alias(name))
    named = sums.join(of("a", "i"), "a").join(of("b", "j"), "b")
    return named.select(month_text(F.col("month_date")).alias("month"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "g")


def folio_top_edges(folios: DataFrame, numbers: DataFrame, *, top_k: int = TOP_EDGES, lagged: bool = False, rows: int = 0) -> DataFrame:
    """As ``top_edges``, from ``folio_edges``."""
    return _ranked(folio_edges(folios, numbers, lagged=lagged, rows=rows), top_k)


def network_degree(positions: DataFrame, *, approximate: int | None = None) -> DataFrame:
    """``(month, permno, network_degree)``: other stocks with a common manager.

    A month's stocks get numbers, and a manager's stocks are the bits of words of 64 numbers, only those that it holds. A stock's neighbours are the OR of the
    words of its managers, so no pair is made. Only words are shuffled: a manager's words meet each other, not its positions. ``approximate``: a book is an HLL sketch with 2**approximate registers instead, and a stock's neighbours are
    a union of sketches, which stay small however many stocks a month has.
    """
    p = _held(positions).select("month", "manager_id", "permno")
    if approximate is not None:
        p = p.repartition("month", "manager_id")
        books = p.groupBy("month", "manager_id").agg(F.hll_sketch_agg("permno", F.lit(approximate)).alias("held"))
        met = p.join(books, ["month", "manager_id"]).groupBy("month", "permno").agg(F.hll_sketch_estimate(F.hll_union_agg("held")).alias("n"))
        return met.select("month", "permno", (F.greatest("n", F.lit(1)) - 1).alias("network_degree"))
    numbered = p.select("month", "permno").distinct().withColumn("n", F.row_number().over(Window.partitionBy("month").orderBy("permno")) - 1)
    numbered = small(written(numbered, "numbered"))
    words = p.join(numbered, ["month", "permno"]).groupBy("month", "manager_id", F.expr("n div 64").alias("word")).agg(F.bit_or(F.expr("1L << (n % 64)")).alias("held"))
    books = words.groupBy("month", "manager_id").agg(F.collect_list(F.struct("word", "held")).alias("book"))
    # a word's bits are laid out and picked, then each stock meets its book's words
    held = books.select("month", F.explode("book").alias("x"), "book").select("month", "x", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), "book")
    stocks = held.where("shiftrightunsigned(x.held, bit) % 2 != 0").select("month", F.expr("64 * x.word + bit").alias("n"), F.explode("book").alias("y"))
    met = stocks.groupBy("month", "n", "y.word").agg(F.bit_or("y.held").alias("held"))
    return met.groupBy("month", "n").agg((F.sum(F.bit_count("held")) - 1).alias("network_degree")).join(numbered, ["month", "n"]).select("month", "permno", "network_degree")


def network_weighted(positions: DataFrame, stock: DataFrame, *, phi: Column | None = None) -> DataFrame:
    """``(month, permno, network_weighted_degree, network_peer_sell_pressure)``; peer pressure is 0 for an isolated stock."""
    p = _held(positions, phi).join(stock.select("month", "permno", F.coalesce("stock_sell_pressure", F.lit(0.0)).alias("s")), ["month", "permno"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    if phi is None:  # ``with_phi`` has placed them
        p = spread(p, "month", "manager_id", rows=positions.count())
    book = Window.partitionBy("month", "manager_id")
    p = p.withColumns({"n": F.count(F.lit(1)).over(book), "s1": F.sum("w").over(book), "s2": F.sum(F.col("w") * F.col("s")).over(book)})
    return _tied(p, ["month", "permno"], F.col("n") == 1, F.col("s1"))


def _named(sums: DataFrame, numbers: DataFrame) -> DataFrame:
    return sums.join(numbers, "n").withColumn("month", month_text(F.col("month_date")))


def folio_degree(folios: DataFrame, numbers: DataFrame) -> DataFrame:
    """As ``network_degree``, from ``ownership.folios`` with ``words``: a book's words stand in its row, so a stock meets them there and only the stocks' words are shuffled."""
    words = [f"w{k}" for k in range(-(-numbers.count() // 64))]
    b = folios.select("month_date", F.explode(F.coalesce("some", F.col("held.n"))).alias("n"), *(F.get("words", F.lit(k)).alias(w) for k, w in enumerate(words)))
    met = b.groupBy("month_date", "n").agg(*(F.bit_or(w).alias(w) for w in words))
    degree = reduce(Column.__add__, (F.bit_count(w) for w in words)) - 1 if words else F.lit(0)
    return _named(met.select("month_date", "n", degree.cast("long").alias("network_degree")), numbers).select("month", "permno", "network_degree")


def folio_weighted(folios: DataFrame, numbers: DataFrame, stock: DataFrame) -> DataFrame:
    """As ``network_weighted``, from ``ownership.folios`` with its ``numbers``: a month's sell pressures are an array by number, so a book is summed up in its row and nothing but the stocks' sums is shuffled."""
    day, s = F.unix_date("month_date"), F.coalesce("stock_sell_pressure", F.lit(0.0)).alias("s")
    pressure = written(stock.join(numbers, "permno").select(day.alias("day"), "n", s), "pressure")
    every = pressure.select("day").distinct().crossJoin(numbers.select("n")).join(pressure, ["day", "n"], "left")
    months = every.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("s", F.lit(0.0)).alias("s")))).alias("of")).select("day", F.col("of.s").alias("of"))
    total = F.col("manager_total_value_proxy")
    b = folios.select(day.alias("day"), "month_date", total, "held").join(small(written(months, "pressures")), "day")
    s2 = F.aggregate("held", F.lit(0.0), lambda a, x: a + x["position_value_proxy"] * F.get("of", x["n"])) / total
    p = b.select("day", "month_date", total, s2.alias("s2"), F.size("held").alias("size"), "held")
    p = p.select("day", "month_date", total, "s2", "size", F.explode("held").alias("x"))
    p = p.select("day", "month_date", "x.n", (F.col("x.position_value_proxy") / total).alias("w"), "s2", "size").where("w > 0").join(small(pressure), ["day", "n"])
    return _named(_tied(p, ["month_date", "n"], F.col("size") == 1, F.lit(1.0)), numbers).select("month", "permno", "network_weighted_degree", "network_peer_sell_pressure")


def _tied(p: DataFrame, by: list[str], alone: Column, whole: Column) -> DataFrame:
    """Weighted degree and peer pressure of rows with the weight ``w``, the sell pressure ``s`` and the book's ``s2``, the sum of both's products; ``whole`` is the sum of its weights.

    A manager with one stock ties it to nothing; rounding must not leave a trace.
    """
    ties = F.when(alone, 0.0).otherwise(F.col("w") * (whole - F.col("w")))
    pressed = F.when(alone, 0.0).otherwise(F.col("w") * (F.col("s2") - F.col("w") * F.col("s")))
    out = p.groupBy(*by).agg(F.sum(ties).alias("network_weighted_degree"), F.sum(pressed).alias("pressed"))
    peer = F.when(F.col("network_weighted_degree") != 0, F.col("pressed") / F.nullif(F.col("network_weighted_degree"), F.lit(0.0))).otherwise(0.0)
    return out.select(*by, "network_weighted_degree", peer.alias("network_peer_sell_pressure"))


def attach_network(stock: DataFrame, degree: DataFrame, weighted: DataFrame) -> DataFrame:
    """The panel: stock features with network columns, 0 where a stock has none."""
    n = degree.join(weighted, ["month", "permno"], "full")
    names = ("network_degree", "network_weighted_degree", "network_peer_sell_pressure")
    return stock.join(n, ["month", "permno"], "left").fillna(0, subset=list(names))
