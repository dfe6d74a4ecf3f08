"""Cross-sectional signal tests: decile sorts, rank information coefficients, correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import finite, require_columns
from holdlens.functions.stats import plain_t, safe_corr
from holdlens.sources.shared import written

# Names of features, controls and targets, and the features whose high values are expected to earn less.
CORE_FEATURES = ["owner_count", "owner_hhi", "top_owner_share", "fragility_proxy", "avg_manager_breadth", "stock_sell_pressure", "network_degree", "network_weighted_degree", "network_peer_sell_pressure"]
CONTROLS = ["mktcap_proxy", "vol"]
TARGETS = ["fwd_ret_1m", "fwd_ret_3m"]
NEGATIVE = {"owner_hhi", "top_owner_share", "fragility_proxy", "stock_sell_pressure", "network_degree", "network_weighted_degree", "network_peer_sell_pressure"}
#: Rows of a pair of columns that are ranked together, about.
PART_ROWS = 1 << 18


def to_long(panel: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """``(month, permno, feature, target, x, y)`` of finite pairs: one scan of the panel for all tests."""
    require_columns(panel, ["month", "permno", *features, *targets])
    xs = F.array(*(F.struct(F.lit(f).alias("feature"), finite(F.col(f)).alias("x")) for f in features))
    ys = F.array(*(F.struct(F.lit(t).alias("target"), finite(F.col(t)).alias("y")) for t in targets))
    long = panel.select("month", "permno", xs.alias("xs"), ys.alias("ys")).select("month", "permno", F.explode("xs").alias("a"), "ys").where("a.x is not null")
    return long.select("month", "permno", "a.feature", "a.x", F.explode("ys").alias("b")).select("month", "permno", "feature", "b.target", "x", "b.y").where("y is not null")


def decile_monthly(long: DataFrame, *, deciles: int = 10, least: int = 5) -> DataFrame:
    """Size, mean and median return of each decile with ``least`` rows; ties go by permno."""
    w = Window.partitionBy("feature", "target", "month").orderBy("x", "permno")
    cells = long.withColumn("decile", F.ntile(deciles).over(w)).groupBy("feature", "target", "month", "decile")
    return cells.agg(F.count(F.lit(1)).alias("n_obs"), F.avg("y").alias("mean_return"), F.median("y").alias("median_return")).where(F.col("n_obs") >= least)


def decile_summary(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("feature", "target", "decile").agg(F.count_distinct("month").alias("months"), F.avg("n_obs").alias("avg_n_obs"), F.avg("mean_return").alias("mean_return"), F.avg("median_return").alias("median_return"))


def spread_monthly(monthly: DataFrame, *, deciles: int = 10) -> DataFrame:
    """Top less bottom decile of each month and the reverse; null if one is absent."""
    of = lambda d: F.max(F.when(F.col("decile") == d, F.col("mean_return")))
    out = monthly.groupBy("feature", "target", "month").agg((of(deciles) - of(1)).alias("high_minus_low"))
    return out.withColumn("low_minus_high", -F.col("high_minus_low"))


def _direction():
    return F.when(F.col("feature").isin(*NEGATIVE), -1.0).otherwise(1.0)


def spread_summary(spreads: DataFrame) -> DataFrame:
    """Mean, annualised mean, plain t and share of positive months, also in the expected direction."""
    s = spreads.where("high_minus_low is not null").withColumn("d", F.col("high_minus_low") * _direction())
    return s.groupBy("feature", "target").agg(
        F.count(F.lit(1)).alias("months"), F.avg("high_minus_low").alias("mean_spread"), (12 * F.avg("high_minus_low")).alias("annualized_spread"), plain_t(F.col("high_minus_low")).alias("t_stat"),
        F.avg((F.col("high_minus_low") > 0).cast("int")).alias("positive_rate"), F.avg("d").alias("directional_mean"), plain_t(F.col("d")).alias("directional_t"), F.avg((F.col("d") > 0).cast("int")).alias("directional_positive_rate"),
    )


def rank_ic_monthly(long: DataFrame, *, least: int = 50) -> DataFrame:
    """Correlation of percent ranks (lowest rank for ties); null where a side is constant."""
    by = Window.partitionBy("feature", "target", "month")
    ranks = long.withColumns({"rx": F.percent_rank().over(by.orderBy("x")), "ry": F.percent_rank().over(by.orderBy("y"))})
    out = ranks.groupBy("feature", "target", "month").agg(F.count(F.lit(1)).alias("n_obs"), safe_corr(F.col("rx"), F.col("ry")).alias("rank_ic"))
    return out.where(F.col("n_obs") >= least)


def rank_ic_summary(monthly: DataFrame) -> DataFrame:
    m = monthly.where("rank_ic is not null").withColumn("d", F.col("rank_ic") * _direction())
    return m.groupBy("feature", "target").agg(
        F.count(F.lit(1)).alias("months"), F.avg("rank_ic").alias("mean_ic"), F.stddev_samp("rank_ic").alias("ic_std"), plain_t(F.col("rank_ic")).alias("t_stat"),
        F.avg((F.col("rank_ic") > 0).cast("int")).alias("positive_rate"), F.avg("d").alias("directional_mean"), plain_t(F.col("d")).alias("directional_t"),
    )


def ranked_by_t(summary: DataFrame, t: str = "directional_t") -> DataFrame:
    """A summary with its place within the target by the size of ``t``, the strongest first; ties by feature."""
    w = Window.partitionBy("target").orderBy(F.abs(t).desc_nulls_last(), "feature")
    return summary.withColumn("place", F.row_number().over(w))


def running_spread(spreads: DataFrame) -> DataFrame:
    """The running sum of the spread in the expected direction; a month without one adds nothing."""
    along = Window.partitionBy("feature", "target").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return spreads.withColumn("cum_directional_spread", F.sum(F.coalesce(F.col("high_minus_low") * _direction(), F.lit(0.0))).over(along))


def feature_correlation(panel: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of all ordered pairs over rows with both, from one pass."""
    x = {f: finite(F.col(f)) for f in features}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = panel.agg(*(safe_corr(x[a], x[b]).alias(f"{a}|{b}") for a, b in pairs))
    cells = [F.struct(F.lit(p).alias("feature_x"), F.lit(q).alias("feature_y"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs for p, q in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _rank_index(long: DataFrame, sides: int) -> DataFrame:
    """``(a, x, ranks)``: the average rank of each value x of a column a, among the rows of each side; from ``long(a, x, here)``.

    ``here``: whether a row belongs to each of the ``sides``. Values are counted first. Each part between quantiles ranks its own values and
    starts from the counts of those before, so no window sees all values.
    """
    counts = long.groupBy("a", "x").agg(F.array(*(F.sum(F.col("here")[k].cast("long")) for k in range(sides))).alias("n"))
    n_parts = max(2, min(1000, -(-long.where(F.col("a") == 0).count() // PART_ROWS)))  # parts only divide the work
    quantiles = F.percentile_approx("x", F.array(*(F.lit(k / n_parts) for k in range(1, n_parts))), 10 * n_parts + 1000)
    cuts = [(r.a, r.cuts) for r in long.groupBy("a").agg(quantiles.alias("cuts")).collect()]  # n_parts values a column
    cuts = F.broadcast(long.sparkSession.createDataFrame(cuts, "a int, cuts array<double>"))
    parts = counts.join(cuts, "a").select("a", "x", "n", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("part"))
    upto, along = Window.partitionBy("a", "part").orderBy("x"), Window.partitionBy("a").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("a", "part").agg(*(F.sum(F.col("n")[k]).alias(f"m{k}") for k in range(sides)))
    starts = sums.select("a", "part", F.array(*(F.coalesce(F.sum(f"m{k}").over(along), F.lit(0)) for k in range(sides))).alias("start"))
    within = parts.withColumn("upto", F.array(*(F.sum(F.col("n")[k]).over(upto) for k in range(sides))))
    rank = lambda k: F.col("start")[k] + F.col("upto")[k] - (F.col("n")[k] - 1) / 2
    return within.join(starts, ["a", "part"]).select("a", "x", F.array(*(rank(k) for k in range(sides))).alias("ranks"))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman correlation of all unordered pairs over rows with both.

    A pair's ranks are among the rows that have both columns. So each value of a column is ranked once for each side: all rows, and the rows that have a
    column with nulls. Each row then meets one index row for each of its columns, not for each pair, and all pairs are summed in one pass.
    """
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), *(finite(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns))), "ranked")
    counted = rows.agg(F.count(F.lit(1)).alias("all"), *(F.count(f"c{i}").alias(f"c{i}") for i in range(len(columns)))).first()
    holes = [i for i in range(len(columns)) if counted[f"c{i}"] < counted["all"]]
    side = {i: k for k, i in enumerate(holes, 1)}  # side 0: all rows
    here = F.array(F.lit(True), *(F.col(f"c{i}").isNotNull() for i in holes))
    cells = F.array(*(F.struct(F.lit(i).alias("a"), F.col(f"c{i}").alias("x")) for i in range(len(columns))))
    long = rows.select("row", here.alias("here"), F.explode(cells).alias("p")).select("row", "here", "p.*").where("x is not null")
    ranked = long.select("row", "a", "x").join(_rank_index(long, 1 + len(holes)), ["a", "x"])
    wide = ranked.groupBy("row").agg(*(F.max(F.when(F.col("a") == i, F.col("ranks"))).alias(f"r{i}") for i in range(len(columns))))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    # sums over the rows that have both; columns without nulls are always there, so most pairs share theirs
    sums: dict[str, tuple[str, Column]] = {}

    def total(i: int, j: int, *factors: Column) -> Column:
        held = reduce(Column.__and__, (F.col(f"r{k}").isNotNull() for k in sorted({i, j} & set(holes))), F.lit(True))
        term = F.sum(F.when(held, reduce(Column.__mul__, factors, F.lit(1.0))))
        return F.col(sums.setdefault(str(term), (f"s{len(sums)}", term))[0])

    found = []
    for i, j in pairs:
        x, y = F.col(f"r{i}")[side.get(j, 0)], F.col(f"r{j}")[side.get(i, 0)]
        n, sx, sy = total(i, j), total(i, j, x), total(i, j, y)
        vx, vy = n * total(i, j, x, x) - sx * sx, n * total(i, j, y, y) - sy * sy
        rho = F.when((vx > 0) & (vy > 0), (n * total(i, j, x, y) - sx * sy) / F.sqrt(vx) / F.sqrt(vy))
        found.append(F.struct(F.lit(columns[i]).alias("feature_x"), F.lit(columns[j]).alias("feature_y"), n.cast("long").alias("n_obs"), rho.alias("spearman")))
    one = wide.agg(*(term.alias(name) for name, term in sums.values()))
    return one.select(F.explode(F.array(*found)).alias("p")).select("p.*").where("n_obs > 0")
