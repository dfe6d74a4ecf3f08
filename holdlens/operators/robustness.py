"""Regimes, strata, placebo, comparison and scorecard of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import annualizer, finite, regime, require_columns
from holdlens.functions.stats import average_rank, newey_west, rank_share, safe_corr


def group_metrics(df: DataFrame, by: list[str], *, returns: str = "actual_return", least: int = 30) -> DataFrame:
    """Rank IC, top-bottom spread and hit rate by month with ``least`` finite rows, then Newey-West over months, a row for each group.

    ``df(target, month, permno, prediction, ...)``; ``by`` has the target.
    """
    cell = [*by, "month"]
    p = require_columns(df, [*cell, "permno", "prediction", returns]).select(*cell, "permno", finite(F.col("prediction")).alias("p"), finite(F.col(returns)).alias("y")).where("p is not null and y is not null")
    p = p.withColumns({"rp": average_rank(cell, "p"), "ry": average_rank(cell, "y"), "share": rank_share(cell, "p")})
    leg = lambda c: F.when(c, F.col("y"))
    m = p.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("rp"), F.col("ry")).alias("rank_ic"), (F.avg(leg(F.col("share") >= 0.9)) - F.avg(leg(F.col("share") <= 0.1))).alias("spread"),
        F.avg(((F.col("p") > 0) == (F.col("y") > 0)).cast("int")).alias("hit"), F.count(leg(F.col("share") >= 0.9)).alias("top"), F.count(leg(F.col("share") <= 0.1)).alias("bottom"),
    ).where(F.col("n") >= least)
    kept = F.col("spread").isNotNull()
    parts = {"rank_ic": F.col("rank_ic"), "spread": F.col("spread"), "hit": F.col("hit"), "top": F.when(kept, F.col("top")).otherwise(0), "bottom": F.when(kept, F.col("bottom")).otherwise(0)}
    each = F.array(*(F.struct(F.lit(k).alias("part"), c.cast("double").alias("v")) for k, c in parts.items()))
    long = m.select(*cell, F.explode(each).alias("x")).select(*cell, "x.*")
    nw = newey_west(long, [*by, "part"], "month", "v")
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    names = {"avg_top_names": ("top", "mean"), "avg_bottom_names": ("bottom", "mean"), "months": ("hit", "n"), "_n": ("spread", "n"), "_std": ("spread", "std")}
    for name, part, t in (("rank_ic_mean", "rank_ic", "rank_ic_t_hac6"), ("spread_mean", "spread", "spread_t_hac6"), ("hit_rate_mean", "hit", "hit_rate_t_hac6")):
        names |= {name: (part, "mean"), t: (part, "t")}
    wide = nw.groupBy(*by).agg(*(of(*x).alias(name) for name, x in names.items()))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).join(wide, by, "left")
    ann = annualizer(F.col("target"))
    out = out.withColumns({"months": F.coalesce("months", F.lit(0)), "annualized_spread_approx": F.col("spread_mean") * ann, "annualized_spread_to_vol_proxy": F.when((F.col("_n") > 2) & (F.col("_std") > 0), F.col("spread_mean") / F.col("_std") * F.sqrt(ann))})
    return out.drop("_n", "_std")


def with_regime(predictions: DataFrame) -> DataFrame:
    """Each row twice: under its regime and under ``all_oos``."""
    years = predictions.withColumn("regime", regime(F.substring("month", 1, 4).cast("int")))
    return years.unionByName(years.withColumn("regime", F.lit("all_oos")))


def regime_metrics(predictions: DataFrame, *, least: int = 30) -> DataFrame:
    return group_metrics(with_regime(predictions), ["model", "target", "regime"], least=least)


def tercile_strata(df: DataFrame, column: str, out: str = "stratum", labels: tuple[str, str, str] = ("low", "mid", "high")) -> DataFrame:
    """``(month, permno, out)``: thirds of each month's stocks by place; ``missing`` without a finite value."""
    base = df.groupBy("month", "permno").agg(F.max(finite(F.col(column))).alias("v"))
    known = base.where("v is not null").withColumn("share", rank_share(["month"], "v"))
    label = F.when(F.col("share") <= 1.0 / 3.0, labels[0]).when(F.col("share") > 2.0 / 3.0, labels[2]).otherwise(labels[1])
    return known.select("month", "permno", label.alias(out)).unionByName(base.where("v is null").select("month", "permno", F.lit("missing").alias(out)))


def stratum_metrics(predictions: DataFrame, panel: DataFrame, column: str, *, least: int = 30) -> DataFrame:
    s = tercile_strata(panel, column).where("stratum != 'missing'")
    return group_metrics(predictions.join(s, ["month", "permno"]), ["model", "target", "stratum"], least=least)


def permuted_returns(predictions: DataFrame, seed: int = 20260529) -> DataFrame:
    """``predictions`` with ``placebo_return``: the month's returns in an order made by a hash, the same each time."""
    cell = ["model", "target", "month"]
    place = Window.partitionBy(*cell).orderBy("permno")
    mixed = Window.partitionBy(*cell).orderBy(F.xxhash64(F.lit(seed), *cell, "permno"), "permno")
    rows = predictions.withColumn("at", F.row_number().over(place))
    given = predictions.select(*cell, F.col("actual_return").alias("placebo_return"), F.row_number().over(mixed).alias("at"))
    return rows.join(given, [*cell, "at"]).drop("at")


def permutation_placebo(predictions: DataFrame, *, seed: int = 20260529, least: int = 30) -> DataFrame:
    """Actual and placebo metrics of each model and target, and the gaps between them."""
    by = ["model", "target"]
    names = ("rank_ic_mean", "rank_ic_t_hac6", "annualized_spread_approx", "spread_t_hac6")
    real = group_metrics(predictions, by, least=least).select(*by, *(F.col(n).alias(f"actual_{n}") for n in names))
    fake = group_metrics(permuted_returns(predictions, seed), by, returns="placebo_return", least=least).select(*by, *(F.col(n).alias(f"placebo_{n}") for n in names))
    out = real.join(fake, by, "left")
    return out.withColumns({"rank_ic_gap_actual_minus_placebo": F.col("actual_rank_ic_mean") - F.col("placebo_rank_ic_mean"), "spread_gap_actual_minus_placebo": F.col("actual_annualized_spread_approx") - F.col("placebo_annualized_spread_approx")})


def model_comparison(performance: DataFrame, *, series: str = "net_return_25bps") -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.col("sharpe_approx").desc_nulls_last())
    return performance.where(F.col("return_series") == series).withColumn("rank_by_sharpe_within_target", F.rank().over(w))


def scorecard(predictions: DataFrame, comparison: DataFrame, attribution: DataFrame, *, least: int = 30) -> DataFrame:
    """One row for each model and target: metrics of all months, net performance, factor fit and placebo."""
    by = ["model", "target"]
    real = group_metrics(predictions, by, least=least).select(*by, *(F.col(n).alias(f"oos_{n}") for n in ("rank_ic_mean", "rank_ic_t_hac6", "annualized_spread_approx", "spread_t_hac6")))
    net = comparison.select(*by, *(F.col(n).alias(f"net25_{n}") for n in ("annualized_mean_return", "sharpe_approx", "nw_t_mean", "cumulative_return", "max_drawdown")))
    f = attribution.where("return_series = 'net_return_25bps'")
    of = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c)))
    fit = f.groupBy(*by).agg(of("const", "annualized").alias("factor_alpha_annualized"), of("const", "t").alias("factor_alpha_t_hac6"), F.max("r2").alias("factor_r2"), *(of(v, "coef").alias(f"factor_beta_{v}") for v in ("mktrf", "smb", "hml")))
    placebo = permutation_placebo(predictions, least=least).drop("actual_rank_ic_mean", "actual_rank_ic_t_hac6", "actual_annualized_spread_approx", "actual_spread_t_hac6")
    return real.join(net, by, "left").join(fit, by, "left").join(placebo, by, "left")


def incremental_delta(comparison: DataFrame, model: str = "all", without: str = "no_network") -> DataFrame:
    """What ``model`` adds to ``without`` in each target; targets without both are left out."""
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    names = {"annualized_mean_return": "delta_net25_annualized_mean_return", "sharpe_approx": "delta_net25_sharpe", "cumulative_return": "delta_net25_cumulative_return"}
    out = comparison.groupBy("target").agg(*((of(model, c) - of(without, c)).alias(n) for c, n in names.items()), F.count_distinct(F.when(F.col("model").isin(model, without), F.col("model"))).alias("found"))
    return out.where("found = 2").select("target", F.lit(f"{model}_minus_{without}").alias("comparison"), *names.values())
