"""An index over validity intervals: non-overlapping pieces, each with the interval that wins there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocks(first: str, after: str) -> Column:
    """Aligned blocks of 2**level pieces, as (level, block), that make up the pieces from ``first`` to before ``after``."""
    return F.expr(f"""
        filter(flatten(transform(sequence(0, length(bin({after})) - 1), l -> array(
            if(ceil({first} / (1L << l)) < {after} div (1L << l) and ceil({first} / (1L << l)) % 2 = 1, struct(l as level, ceil({first} / (1L << l)) as block), null),
            if(ceil({first} / (1L << l)) < {after} div (1L << l) and {after} div (1L << l) % 2 = 1, struct(l as level, {after} div (1L << l) - 1 as block), null)
        ))), x -> x is not null)""")


def interval_index(intervals: DataFrame, key: str, start: str, end: str, order: list[Column]) -> DataFrame:
    """``(key, piece_start, piece_end, ...)`` with the other columns of the interval that is first by ``order`` among those that hold the piece.

    Dates on both ends belong to an interval; ones that end before they start, and those with a null key or date, hold nothing. Days that no interval holds
    are in no piece. Intervals that agree in ``order`` go by their other columns. Each interval is laid over a key's pieces as a few aligned
    blocks, as in a segment tree; a block keeps its best interval, and a piece takes the best of the blocks above it. So work grows with k log k
    for k intervals of a key, however they nest, and no task needs to hold a key's intervals.
    """
    others = [c for c in intervals.columns if c not in (key, start, end)]
    rows = intervals.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(F.col(f"`{c}`") for c in others), F.col(start), F.col(end)).alias("rank")
    rows = rows.select(F.col(key).alias("k"), F.col(start).alias("a"), F.date_add(end, 1).alias("z"), rank)
    points = rows.select("k", F.explode(F.array("a", "z")).alias("day")).distinct()
    w = Window.partitionBy("k").orderBy("day")
    points = points.select("k", "day", (F.row_number().over(w) - 1).cast("long").alias("piece"), F.lead("day").over(w).alias("until"))
    of = lambda day, name: points.select("k", F.col("day").alias(day), F.col("piece").alias(name))
    laid = rows.join(of("a", "first"), ["k", "a"]).join(of("z", "after"), ["k", "z"])
    best = laid.select("k", F.explode(_blocks("first", "after")).alias("x"), "rank").groupBy("k", "x.level", "x.block").agg(F.min("rank").alias("rank"))
    sizes = Window.partitionBy("k")
    points = points.withColumn("pieces", F.max("piece").over(Window.partitionBy("k")) + 1)
    above = F.expr("transform(sequence(0, length(bin(pieces)) - 1), l -> struct(l as level, shiftright(piece, l) as block))")
    asked = points.select("k", "day", "until", F.explode(above).alias("x")).select("k", "day", "until", F.col("x.level").alias("level"), F.col("x.block").alias("block"))
    found = asked.join(best, ["k", "level", "block"]).groupBy("k", "day", "until").agg(F.min("rank").alias("rank"))
    return found.select(F.col("k").alias(key), F.col("day").alias("piece_start"), F.date_sub("until", 1).alias("piece_end"), *(F.col(f"rank.`{c}`").alias(c) for c in others))
