"""Long-short decile portfolios with turnover, costs, performance and factor attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import annualizer, month_text, require_columns
from holdlens.functions.stats import newey_west, rank_share
from holdlens.operators.econometrics import hac_regression

#: Levels of cost in basis points.
COST_BPS = (0, 5, 10, 25, 50)
CELL = ["model", "target", "month"]
#: Names of the factors.
FACTORS = ["mktrf", "smb", "hml", "umd", "rmw", "cma"]


def decile_holdings(predictions: DataFrame) -> DataFrame:
    """The top and bottom tenth of each month by place over size, with weights of half over their number."""
    sel = require_columns(predictions, [*CELL, "permno", "prediction", "actual_return"]).withColumn("share", rank_share(CELL, "prediction"))
    sel = sel.withColumn("side", F.when(F.col("share") >= 0.9, 1).when(F.col("share") <= 0.1, -1).otherwise(0)).where("side != 0")
    sel = sel.withColumn("n_side", F.count("permno").over(Window.partitionBy(*CELL, "side")))
    return sel.select(*CELL, "permno", "side", "prediction", "actual_return", "n_side", (0.5 * F.col("side") / F.col("n_side")).alias("weight"))


def decile_portfolio(holdings: DataFrame) -> DataFrame:
    """Returns and sizes of both legs for each month."""
    leg = lambda s, c: F.when(F.col("side") == s, F.col(c))
    out = holdings.groupBy(*CELL).agg(
        F.sum(F.col("weight") * F.col("actual_return")).alias("gross_dollar_neutral_return"), F.avg(leg(-1, "actual_return")).alias("short_leg_mean_return"), F.avg(leg(1, "actual_return")).alias("long_leg_mean_return"),
        F.count(leg(-1, "permno")).alias("n_short"), F.count(leg(1, "permno")).alias("n_long"),
    )
    return out.withColumn("academic_spread_return", F.col("long_leg_mean_return") - F.col("short_leg_mean_return"))


def turnover(holdings: DataFrame) -> DataFrame:
    """Sum of absolute weight changes since the month before that has holdings; all of the first month counts."""
    months = holdings.select(*CELL).distinct().withColumn("t", F.row_number().over(Window.partitionBy("model", "target").orderBy("month")))
    now = holdings.join(months, CELL).select("model", "target", "permno", "t", F.col("weight").alias("w"))
    before = now.select("model", "target", "permno", (F.col("t") + 1).alias("t"), F.col("w").alias("w0"))
    change = now.join(before, ["model", "target", "permno", "t"], "full").groupBy("model", "target", "t").agg(
        F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("turnover_abs_change"), F.sum(F.abs("w")).alias("gross_exposure"), F.sum("w").alias("net_exposure"), F.count("w").alias("n_names")
    )
    out = months.join(change, ["model", "target", "t"])  # without the month after the last
    return out.select(*CELL, "turnover_abs_change", (F.col("turnover_abs_change") / 2).alias("turnover_one_way"), "gross_exposure", "net_exposure", "n_names")


def apply_costs(portfolio: DataFrame, bps: tuple[int, ...] = COST_BPS, *, basis: str = "turnover_abs_change") -> DataFrame:
    """``net_return_{bps}bps``: gross less cost times ``basis``."""
    return portfolio.select("*", *((F.col("gross_dollar_neutral_return") - b / 10000.0 * F.col(basis)).alias(f"net_return_{b}bps") for b in bps))


def portfolio_of(held: DataFrame, bps: tuple[int, ...] = COST_BPS) -> DataFrame:
    """Returns, turnover and net returns of what ``decile_holdings`` chose."""
    return apply_costs(decile_portfolio(held).join(turnover(held), CELL, "left"), bps)


def build_portfolio(predictions: DataFrame, bps: tuple[int, ...] = COST_BPS) -> DataFrame:
    return portfolio_of(decile_holdings(predictions), bps)


def _series(portfolio: DataFrame, columns: list[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(c).alias("return_series"), F.col(c).alias("r")) for c in columns))
    rows = portfolio.select(*CELL, "turnover_abs_change", "turnover_one_way", "n_long", "n_short", F.explode(each).alias("x"))
    return rows.select(*CELL, "turnover_abs_change", "turnover_one_way", "n_long", "n_short", "x.*").where("r is not null")


def _with_drawdown(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``series`` with the fall of wealth below its highest value so far, and the month of that value."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w = series.withColumn("wealth", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(run))
    w = w.withColumn("peak_wealth", F.max("wealth").over(run)).withColumn("drawdown", F.col("wealth") / F.col("peak_wealth") - 1)
    # the month of the highest wealth so far: the last one that set a new high
    high = F.lag("peak_wealth").over(Window.partitionBy(*by).orderBy(order))
    w = w.withColumn("fresh", high.isNull() | (F.col("wealth") > high))
    return w.withColumn("peak_month", F.last(F.when(F.col("fresh"), F.col(order)), ignorenulls=True).over(run)).drop("wealth", "peak_wealth", "fresh")


def _fall(order: str) -> dict[str, Column]:
    deepest = F.struct("drawdown", order)
    return {"max_drawdown": F.min("drawdown"), "peak": F.min_by("peak_month", deepest), "trough": F.min_by(order, deepest)}


def max_drawdown(series: DataFrame, by: list[str], order: str = "month", value: str = "r") -> DataFrame:
    """``(by, max_drawdown, peak, trough)``: the deepest fall of wealth below its highest value so far.

    The first wealth value is the first peak, so a loss in the first month is none. First months win ties. A null return is 0.
    """
    return _with_drawdown(series, by, order, value).groupBy(*by).agg(*(c.alias(name) for name, c in _fall(order).items()))


def performance_summary(portfolio: DataFrame, bps: tuple[int, ...] = COST_BPS) -> DataFrame:
    """Performance of the gross and each net series of each model and target.

    Three-month targets are held monthly, so their returns overlap; they are annualised by 4 and compounded as they are.
    """
    by = ["model", "target", "return_series"]
    s = _series(portfolio, ["gross_dollar_neutral_return", *(f"net_return_{b}bps" for b in bps)])
    also = {"hit_rate": F.avg((F.col("r") > 0).cast("int")), "cumulative_return": F.product(1 + F.col("r")) - 1}
    also |= {f"avg_{c}": F.avg(c) for c in ("turnover_abs_change", "turnover_one_way", "n_long", "n_short")}
    out = newey_west(_with_drawdown(s, by, "month", "r"), by, "month", "r", also=also | _fall("month"))
    out = out.withColumnsRenamed({"n": "months", "mean": "mean_period_return", "t": "nw_t_mean", "peak": "max_drawdown_peak_month", "trough": "max_drawdown_trough_month"}).drop("se")
    out = out.withColumns({"annualized_mean_return": annualizer(F.col("target")) * F.col("mean_period_return"), "annualized_volatility": F.sqrt(annualizer(F.col("target"))) * F.col("std")}).drop("std")
    return out.withColumn("sharpe_approx", F.when(F.col("annualized_volatility") > 0, F.col("annualized_mean_return") / F.col("annualized_volatility")))


def cost_sensitivity(portfolio: DataFrame, bps: tuple[int, ...] = COST_BPS) -> DataFrame:
    by = ["model", "target", "cost_bps"]
    s = _series(portfolio, [f"net_return_{b}bps" for b in bps]).withColumn("cost_bps", F.regexp_extract("return_series", r"(\d+)bps", 1).cast("int"))
    nw = newey_west(s, by, "month", "r", also={"cumulative_return": F.product(1 + F.col("r")) - 1, "avg_turnover_abs_change": F.avg("turnover_abs_change")})
    return nw.select(*by, F.col("n").alias("months"), (annualizer(F.col("target")) * F.col("mean")).alias("annualized_mean_return"), F.col("t").alias("nw_t_mean"), "cumulative_return", "avg_turnover_abs_change")


def prepare_factors(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Factors by month as decimals: renamed, the last row of a month, months in [start, end]; in percent if a median size is above 0.5."""
    names = {"mkt_rf": "mktrf", "mkt-rf": "mktrf", "mom": "umd"}
    df = raw.select(*(F.col(f"`{c}`").alias(names.get(c.lower(), c.lower())) for c in raw.columns))
    found = [f for f in FACTORS if f in df.columns]
    df = df.withColumn("month", month_text(F.col("date"))).where(F.col("month").between(start, end))
    df = df.groupBy("month").agg(*(F.max_by(f, "date").alias(f) for f in found)).na.drop(subset=[f for f in ("mktrf", "smb", "hml") if f in found])
    size = df.agg(*(F.median(F.abs(f)).alias(f) for f in found)).first()  # one row
    return df.select("month", *((F.col(f) / 100 if (size[f] or 0) > 0.5 else F.col(f)).alias(f) for f in found))


def factor_attribution(portfolio: DataFrame, factors: DataFrame, *, lags: int = 6, least: int = 36) -> DataFrame:
    """``(model, target, return_series, n, r2, variable, coef, t, annualized)``; the constant is alpha."""
    xs = [f for f in FACTORS if f in factors.columns]
    s = _series(portfolio, ["gross_dollar_neutral_return", "net_return_25bps"]).select(*CELL, "return_series", "r").join(factors, "month")
    out = hac_regression(s, ["model", "target", "return_series"], "month", "r", xs, lags=lags, least=least)
    return out.withColumn("annualized", F.when(F.col("variable") == "const", annualizer(F.col("target")) * F.col("coef")))


def holding_counts(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy(*CELL, "side").agg(F.count("permno").alias("names"))


def select_headline(performance: DataFrame, *, target: str = "fwd_ret_1m", series: str = "net_return_25bps") -> DataFrame:
    """The best row by Sharpe ratio, then mean; of all rows if the wanted target and series have none."""
    wanted = ((F.col("target") == target) & (F.col("return_series") == series)).cast("int")
    return performance.orderBy(wanted.desc(), F.col("sharpe_approx").desc_nulls_last(), F.col("annualized_mean_return").desc_nulls_last(), "model", "target", "return_series").limit(1)
