"""Exact quantiles of whole tables without bringing their values together."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.sources.shared import written

#: Values that one task may sort at the end, for each quantile.
FEW = 20_000
#: Accuracy of the sketches that narrow a range, and the share of its values that is taken on either side of the wanted place.
ACCURACY, MARGIN = 5_000, 1e-3


@dataclass
class _Wanted:
    """The quantile ``p`` of a column: the place of its lower value, how far it lies from there, and the range that holds both neighbours."""

    name: str
    p: float
    place: int
    part: float
    low: float
    high: float
    below: int
    inside: int

    def within(self) -> Column:
        return _value(self.name).between(self.low, self.high)


def _value(name: str) -> Column:
    """Nulls and not-a-number have no place."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def _bounds(df: DataFrame, asked: dict[str, list[float]]) -> list[_Wanted]:
    one = df.agg(*(f(_value(c)).alias(f"{k}{i}") for i, c in enumerate(asked) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    out = []
    for i, (c, ps) in enumerate(asked.items()):
        n = one[f"n{i}"]
        for p in ps:
            at = p * (n - 1) if n else 0.0
            out.append(_Wanted(c, p, math.floor(at), at - math.floor(at), one[f"lo{i}"] if n else 0.0, one[f"hi{i}"] if n else 0.0, 0, n))
    return out


def _narrow(df: DataFrame, wide: list[_Wanted]) -> None:
    """Smaller ranges for ``wide``: sketches of the values inside say where to look, and counts say what really is there."""
    marks = []
    for i, w in enumerate(wide):
        at = (w.place - w.below) / max(1, w.inside - 1)
        ends = [max(0.0, at - MARGIN), min(1.0, at + MARGIN + 1 / w.inside)]
        marks.append(F.percentile_approx(F.when(w.within(), _value(w.name)), F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias(f"m{i}"))
    found = df.agg(*marks).first()
    counts = []
    for i, w in enumerate(wide):
        a, b, x = found[f"m{i}"][0], found[f"m{i}"][1], F.when(w.within(), _value(w.name))
        counts += [F.count(F.when(x < a, 1)).alias(f"l{i}"), F.count(F.when((x >= a) & (x <= b), 1)).alias(f"i{i}"), F.max(F.when(x < a, x)).alias(f"u{i}"), F.min(F.when(x > b, x)).alias(f"o{i}")]
    said = df.agg(*counts).first()
    for i, w in enumerate(wide):
        a, b, below, inside = found[f"m{i}"][0], found[f"m{i}"][1], said[f"l{i}"], said[f"i{i}"]
        first, last = w.place - w.below, w.place - w.below + (w.part > 0)
        if first < below:  # the sketch was too high
            w.high, w.inside = (b, below + inside) if last >= below else (said[f"u{i}"], below)
        elif last >= below + inside:
            w.low, w.below, w.inside = (a, w.below + below, w.inside - below) if first < below + inside else (said[f"o{i}"], w.below + below + inside, w.inside - below - inside)
        else:
            w.low, w.high, w.below, w.inside = a, b, w.below + below, inside


def exact_quantiles(df: DataFrame, asked: dict[str, list[float]], *, is_table: bool = False) -> DataFrame:
    """``(name, p, value)``: quantiles of the columns in ``asked``, linear between neighbours; null without values.

    Each round reads ``df`` twice: sketches give a narrow range around the wanted place, and counts say how many values lie below and in
    it, so a range shrinks by hundreds of times, whatever the distribution. Values that tie end it. The last ``FEW`` values of each quantile are
    sorted; no task sees more. The driver gets a few numbers a round. The columns are written first, as they are read several times, unless ``df`` ``is_table``.
    """
    if not is_table:
        df = written(df.select(*asked), "quantiles")
    wanted = _bounds(df, asked)
    while wide := [w for w in wanted if w.inside > FEW and w.low < w.high]:
        before = [w.inside for w in wide]
        _narrow(df, wide)
        if [w.inside for w in wide] == before:
            raise ArithmeticError(f"no narrower range for {[(w.name, w.p) for w in wide]}")
    # values that tie are one row with a count
    few = F.array(*(F.struct(F.lit(i).alias("i"), F.when(w.within(), _value(w.name)).alias("x")) for i, w in enumerate(wanted)))
    values = df.select(F.explode(few).alias("v")).select("v.*").where("x is not null").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("x"))
    places = df.sparkSession.createDataFrame([(i, w.name, float(w.p), w.place - w.below, w.part) for i, w in enumerate(wanted)], "i int, name string, p double, place long, part double")
    placed = values.withColumn("upto", upto).join(F.broadcast(places), "i")
    value_at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    got = placed.groupBy("i").agg(value_at(F.col("place")).alias("a"), value_at(F.col("place") + 1).alias("b"))
    value = F.when(F.col("part") > 0, F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).otherwise(F.col("a"))
    return places.join(got, "i", "left").select("name", "p", value.alias("value"))
