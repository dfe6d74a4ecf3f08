"""Grouped statistics as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import clamp


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null where a side is constant; aggregates rows with both."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def average_rank(by: list[str], value: str) -> Column:
    """Rank within ``by`` with ties at their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def rank_share(by: list[str], value: str, tie: str = "permno") -> Column:
    """Place by (value, tie) within ``by``, divided by the number of rows."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def plain_t(x: Column) -> Column:
    """mean / (sd / sqrt(n)); null below three values or without spread."""
    return F.when(F.count(x) >= 3, F.avg(x) / F.nullif(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0)))


def newey_west(df: DataFrame, by: list[str], order: str, value: str, max_lag: int = 6, also: dict[str, Column] | None = None) -> DataFrame:
    """``by``, n, mean, se, t and std of the mean of ``value`` with Bartlett weights, a row for each group.

    Nulls are left out, so rows on both sides of one are neighbours. Lags: max_lag, n - 1 at most. One value: no se.
    ``also``: further aggregates of ``df`` by name, taken in the same pass. All windows and the aggregate share one shuffle.
    """
    group, along = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).withColumn("nw_x", F.col(value).cast("double"))
    rows = rows.withColumn("nw_d", F.col("nw_x") - F.avg("nw_x").over(group))
    lags = range(1, max_lag + 1)
    rows = rows.select("*", *(F.lag("nw_d", k).over(along).alias(f"nw_d{k}") for k in lags))
    sums = rows.groupBy(*by).agg(
        F.count("nw_x").alias("n"), F.avg("nw_x").alias("mean"), F.stddev_samp("nw_x").alias("std"), F.sum(F.col("nw_d") * F.col("nw_d")).alias("g0"),
        *(F.coalesce(F.sum(F.col("nw_d") * F.col(f"nw_d{k}")), F.lit(0.0)).alias(f"g{k}") for k in lags),
        *(c.alias(name) for name, c in (also or {}).items()),
    )
    used = F.least(F.lit(max_lag), F.col("n") - 1)
    var = F.col("g0")
    for k in lags:
        var = var + F.when(F.lit(k) <= used, 2 * (1 - k / (used + 1.0)) * F.col(f"g{k}")).otherwise(0.0)
    se = F.when(F.col("n") > 1, F.sqrt(F.greatest(var / F.col("n"), F.lit(0.0)) / F.col("n")))
    out = sums.withColumn("se", se)
    return out.select(*by, "n", "mean", "se", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).alias("t"), "std", *(also or {}))


def winsorize(df: DataFrame, by: list[str], columns: list[str], low: float = 0.01, high: float = 0.99, min_n: int = 0) -> DataFrame:
    """``columns`` moved into their group's quantiles (linear), where the group has ``min_n`` values or more."""
    cuts = df.groupBy(*by).agg(*(x for c in columns for x in (F.percentile(c, F.lit(low)).alias(f"{c}__lo"), F.percentile(c, F.lit(high)).alias(f"{c}__hi"), F.count(c).alias(f"{c}__n"))))
    joined = df.join(cuts, by, "left")
    moved = {c: F.when(F.col(f"{c}__n") >= min_n, clamp(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi"))).otherwise(F.col(c)) for c in columns}
    return joined.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in df.columns))


def zscore(df: DataFrame, by: list[str], columns: list[str], prefix: str = "z_") -> DataFrame:
    """``z_`` columns: (x - mean) / sd within ``by``, null without spread."""
    w = Window.partitionBy(*by)
    return df.select("*", *(((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))).alias(f"{prefix}{c}") for c in columns))


def robust_zscore(df: DataFrame, by: list[str], columns: list[str], limit: float = 5.0, prefix: str = "rz_") -> DataFrame:
    """(x - median) / sd within ``by``; null and no spread become 0; at most ``limit`` either way."""
    marks = df.groupBy(*by).agg(*(x for c in columns for x in (F.median(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s"))))
    joined = df.join(marks, by, "left")
    z = {c: clamp(F.coalesce((F.col(c) - F.col(f"{c}__m")) / F.nullif(F.col(f"{c}__s"), F.lit(0.0)), F.lit(0.0)), F.lit(-limit), F.lit(limit)) for c in columns}
    return joined.select(*df.columns, *(z[c].alias(f"{prefix}{c}") for c in columns))


def products(df: DataFrame, pairs: list[tuple[str, str]], limit: float | None = None) -> DataFrame:
    """A column ``a_x_b`` for each pair, at most ``limit`` either way."""
    out = []
    for a, b in pairs:
        p = F.col(a) * F.col(b)
        out.append((p if limit is None else clamp(p, F.lit(-limit), F.lit(limit))).alias(f"{a}_x_{b}"))
    return df.select("*", *out)


def gram(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """n, and sums of y, y*y and of all products of ``xs`` with a constant, over complete rows, a row for each group.

    sxx: upper triangle by rows with the constant first; sxy in the same order.
    """
    full = df.na.drop(subset=[y, *xs])
    cols = [F.lit(1.0), *(F.col(x) for x in xs)]
    upper = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.array(*(F.sum(c * F.col(y)) for c in cols)).alias("sxy"), F.array(*upper).alias("sxx"))
