"""Profiles, audits and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.quantiles import exact_quantiles


def _quantile_metrics(df: DataFrame, names: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value) rows; ``names``: the column and the share of each metric."""
    asked: dict[str, list[float]] = {}
    for c, p in names.values():
        asked.setdefault(c, []).append(p)
    metrics = df.sparkSession.createDataFrame([(m, c, p) for m, (c, p) in names.items()], "metric string, name string, p double")
    return F.broadcast(metrics).join(exact_quantiles(df, asked), ["name", "p"]).select("metric", "value")


def _tall(df: DataFrame, names: list[str], key: str = "metric", value: str = "value") -> DataFrame:
    """One row as (key, value) rows of doubles."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias(key), F.col(n).cast("double").alias(value)) for n in names))).alias("x")).select("x.*")


def profile_source(df: DataFrame, keys: list[str], dates: list[str] | None = None) -> DataFrame:
    """``(column, rows, non_null_rate, distinct_values, min_date, max_date)`` in one pass over ``df``."""
    dates = dates or []
    parts = [x for c in keys for x in (F.count(c).alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__d"))]
    ends = [x for c in dates for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *parts, *ends)
    def row(c):
        lo, hi = (F.col(f"{c}__{e}").cast("date") if c in dates else F.lit(None).cast("date") for e in ("lo", "hi"))
        return F.struct(F.lit(c).alias("column"), F.col("rows"), (F.col(f"{c}__n") / F.nullif(F.col("rows"), F.lit(0))).alias("non_null_rate"), F.col(f"{c}__d").alias("distinct_values"), lo.alias("min_date"), hi.alias("max_date"))
    return one.select(F.explode(F.array(*(row(c) for c in keys))).alias("x")).select("x.*")


def audit_holdings(holdings: DataFrame) -> DataFrame:
    """Filing lags and shares as (metric, value)."""
    lag = F.col("filing_lag_days").cast("double")
    one = holdings.agg(
        F.avg(lag).alias("lag_mean"), F.min(lag).alias("lag_min"), F.max(lag).alias("lag_max"),
        F.avg((F.coalesce("shares", F.lit(0.0)) > 0).cast("int")).alias("shares_positive_rate"), F.avg((lag < 0).cast("int")).alias("negative_lag_share"),
    )
    return _tall(one, one.columns).unionByName(_quantile_metrics(holdings, {f"lag_p{p:02d}": ("filing_lag_days", p / 100) for p in (5, 50, 95)}))


def audit_key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides, those in both, and the share of left rows whose key the right has."""
    r = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("hit", F.lit(1))
    # sizes of key groups first, so that a hot key is one row of the join
    l = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    both = l.join(r, key, "full")
    one = both.agg(
        F.count("rows").alias("left_keys"), F.count("hit").alias("right_keys"), F.sum((F.col("rows").isNotNull() & F.col("hit").isNotNull()).cast("int")).alias("common_keys"),
        (F.sum(F.when(F.col("hit").isNotNull(), F.col("rows")).otherwise(0)) / F.nullif(F.sum("rows"), F.lit(0))).alias("left_row_overlap_rate"),
    )
    return _tall(one, one.columns)


def audit_universe(names: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    one = names.agg(rate(F.col("shrcd").isin(10, 11)).alias("common_share_rate"), *(rate(F.col("exchcd") == k).alias(f"exchange_{k}_rate") for k in (1, 2, 3)))
    return _tall(one, one.columns)


def audit_returns(monthly: DataFrame) -> DataFrame:
    one = monthly.agg(F.avg((F.abs("prc") >= 5).cast("int")).alias("price_at_least_5_rate"))
    return _tall(one, one.columns).unionByName(_quantile_metrics(monthly, {f"ret_p{p:02d}": ("ret", p / 100) for p in (1, 50, 99)}))


def build_metrics(holdings: DataFrame, mapped: DataFrame, positions: DataFrame, panel: DataFrame) -> DataFrame:
    """Counts and coverages of a build as (metric, value)."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(n).alias("metric"), "value")
    h, m = count(holdings, "clean_holdings_rows"), count(mapped, "mapped_common_rows")
    of = lambda n: F.max(F.when(F.col("metric") == n, F.col("value")))
    rate = h.unionByName(m).agg((of("mapped_common_rows") / F.greatest(of("clean_holdings_rows"), F.lit(1.0))).alias("value")).select(F.lit("common_mapping_rate").alias("metric"), "value")
    p = panel.agg(
        F.count(F.lit(1)).alias("panel_rows"), F.count_distinct("month").alias("panel_months"), F.count_distinct("permno").alias("panel_stocks"),
        F.avg(F.col("fwd_ret_1m").isNotNull().cast("int")).alias("fwd_ret_1m_coverage"), F.avg(F.col("fwd_ret_3m").isNotNull().cast("int")).alias("fwd_ret_3m_coverage"),
    )
    medians = _quantile_metrics(panel, {f"median_{c}": (c, 0.5) for c in ("owner_count", "network_degree")})
    return h.unionByName(m).unionByName(rate).unionByName(count(positions, "position_rows")).unionByName(_tall(p, p.columns)).unionByName(medians)


def quality_gate(metrics: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """``(metric, value, threshold, ok, status)``; status: of the whole. A metric that is missing isn't ok."""
    want = metrics.sparkSession.createDataFrame([(k, float(v)) for k, v in minimums.items()], "metric string, threshold double")
    out = F.broadcast(want).join(metrics, "metric", "left").withColumn("ok", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))
    every = F.min(F.col("ok").cast("int")).over(Window.partitionBy(F.lit(1)))  # a row for each minimum
    return out.select("metric", "value", "threshold", "ok", F.when(every == 1, "ok").otherwise("needs_attention").alias("status"))


def describe_panel(panel: DataFrame) -> DataFrame:
    cover = lambda c: F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_coverage")
    return panel.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("month").alias("months"), F.count_distinct("permno").alias("stocks"), F.min("month").alias("min_month"), F.max("month").alias("max_month"), cover("fwd_ret_1m"), cover("fwd_ret_3m"))


def feature_coverage(panel: DataFrame, features: list[str], core: set[str], negative: set[str]) -> DataFrame:
    """A row for each feature: a pass that sums up months, then one over months; medians by narrowing."""
    def of_month(f: str) -> list[Column]:
        x = F.col(f).try_cast("double")
        return [F.count(f).alias(f"{f}__n"), F.sum(x).alias(f"{f}__sum"), F.count(x).alias(f"{f}__c"), F.min(x).alias(f"{f}__lo"), F.max(x).alias(f"{f}__hi")]

    def whole(f: str) -> list[Column]:
        n = F.col(f"{f}__n")
        return [F.sum(n).alias(f"{f}__n"), F.count(F.when(n > 0, F.col("month"))).alias(f"{f}__m"), (F.sum(f"{f}__sum") / F.nullif(F.sum(f"{f}__c"), F.lit(0))).alias(f"{f}__avg"), F.min(f"{f}__lo").alias(f"{f}__lo"), F.max(f"{f}__hi").alias(f"{f}__hi")]

    months = panel.groupBy("month").agg(F.count(F.lit(1)).alias("total"), *(p for f in features for p in of_month(f)))
    one = months.agg(F.sum("total").alias("total"), *(p for f in features for p in whole(f)))
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(f in core).alias("is_core_signal"), F.lit("negative" if f in negative else "not_prespecified").alias("expected_high_minus_low_sign"),
            F.col(f"{f}__n").alias("non_null_rows"), (F.col(f"{f}__n") / F.greatest(F.col("total"), F.lit(1))).alias("coverage"), F.col(f"{f}__m").alias("months_non_null"),
            F.col(f"{f}__avg").alias("mean_value"), F.col(f"{f}__lo").alias("min_value"), F.col(f"{f}__hi").alias("max_value"),
        )
        for f in features
    ]
    medians = exact_quantiles(panel.select(*(F.col(f).try_cast("double").alias(f) for f in features)), {f: [0.5] for f in features})
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").join(medians.select(F.col("name").alias("feature"), F.col("value").alias("median_value")), "feature")
