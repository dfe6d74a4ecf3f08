"""Expanding-window out-of-sample models and their evaluation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import annualizer, finite, require_columns
from holdlens.functions.stats import average_rank, gram, newey_west, rank_share, safe_corr, winsorize
from holdlens.sources.shared import cut

ALPHAS = (0.1, 1.0, 3.0, 10.0, 30.0, 100.0)
#: Rows with a target that a split needs for training, validation and test.
LEAST_ROWS = (10000, 1000, 1000)


def horizon(target: str) -> int:
    return 3 if target.endswith("3m") else 1


def expanding_splits(panel: DataFrame, target: str, *, valid: int = 24, min_train: int = 96, least_valid: int = 6) -> DataFrame:
    """``(target, test_year, train_end, valid_start, valid_end, first_test)`` as month numbers from 0; ends are exclusive.

    The embargo between the parts is the target's horizon. Years without enough months before them are left out.
    """
    months = require_columns(panel, ["month", target]).groupBy("month").agg(F.count(target).alias("n"))  # a row for each month
    months = months.withColumn("i", F.row_number().over(Window.orderBy("month")) - 1)
    first = months.where("n > 0").groupBy(F.substring("month", 1, 4).cast("int").alias("test_year")).agg(F.min("i").alias("first_test"))
    h = horizon(target)
    s = first.withColumn("valid_end", F.col("first_test") - h).withColumn("valid_start", F.col("valid_end") - valid).withColumn("train_end", F.col("valid_start") - h)
    s = s.where((F.col("train_end") >= min_train) & (F.col("valid_end") - F.greatest("valid_start", F.lit(0)) >= least_valid))
    return s.select(F.lit(target).alias("target"), "test_year", "train_end", F.greatest("valid_start", F.lit(0)).alias("valid_start"), "valid_end", "first_test")


def split_months(panel: DataFrame, splits: DataFrame, target: str) -> DataFrame:
    """``(test_year, role, month)`` of each split; roles are joined by month number, test months by year."""
    months = panel.groupBy("month").agg(F.count(target).alias("n")).withColumn("i", F.row_number().over(Window.orderBy("month")) - 1)
    span = lambda role, lo, hi: F.struct(F.lit(role).alias("role"), F.col(lo).cast("int").alias("lo"), F.col(hi).cast("int").alias("hi"))
    ranges = splits.withColumn("zero", F.lit(0)).select("test_year", F.explode(F.array(span("train", "zero", "train_end"), span("valid", "valid_start", "valid_end"))).alias("x")).where("x.lo < x.hi")
    fitted = ranges.select("test_year", "x.role", F.explode(F.sequence(F.col("x.lo"), F.col("x.hi") - 1)).alias("i")).join(months.select("i", "month"), "i")
    tests = months.where("n > 0").select("month", F.substring("month", 1, 4).cast("int").alias("test_year")).join(splits.select("test_year"), "test_year")
    return fitted.select("test_year", "role", "month").unionByName(tests.select("test_year", F.lit("test").alias("role"), "month"))


def feature_sets(features: list[str]) -> dict[str, list[str]]:
    """All features, those without the network, and those of the network and of selling pressure; empty sets are left out."""
    sets = {"all": features, "no_network": [f for f in features if "network" not in f], "network_pressure": [f for f in features if "network" in f or "sell_pressure" in f]}
    return {name: xs for name, xs in sets.items() if xs}


def enough_rows(panel: DataFrame, splits: DataFrame, target: str, least: tuple[int, int, int] = LEAST_ROWS) -> DataFrame:
    """The splits whose training, validation and test months have ``least`` rows with a target."""
    rows = panel.groupBy("month").agg(F.count(target).alias("rows"))  # a row for each month
    sizes = split_months(panel, splits, target).join(rows, "month").groupBy("test_year")
    sizes = sizes.agg(*(F.sum(F.when(F.col("role") == role, F.col("rows"))).alias(role) for role in ("train", "valid", "test")))
    ok = sizes.where(" and ".join(f"{role} >= {n}" for role, n in zip(("train", "valid", "test"), least, strict=True)))
    return splits.join(ok.select("test_year"), "test_year", "left_semi")


def _system(row, k: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    sxx = np.zeros((k, k))
    sxx[np.triu_indices(k)] = row.sxx
    return float(row.n), float(row.syy), np.array(row.sxy), sxx + np.triu(sxx, 1).T


def ridge_fit(panel: DataFrame, splits: DataFrame, target: str, xs: list[str], *, alphas: tuple[float, ...] = ALPHAS) -> list[dict]:
    """For each split the ridge of least validation error: test_year, alpha, valid_mse, intercept, coef and rows.

    One pass makes each month's sums of products; sums over months give every training and validation set. The
    target is winsorised within months. The driver holds a row of these sums for each month.
    """
    k = len(xs) + 1
    data = winsorize(panel.where(F.col(target).isNotNull()), ["month"], [target])
    by_month = {r.month: _system(r, k) for r in gram(data, ["month"], target, xs).collect()}
    out = []
    roles: dict[int, dict[str, list[str]]] = {}
    for r in split_months(panel, splits, target).collect():
        roles.setdefault(r.test_year, {}).setdefault(r.role, []).append(r.month)
    for year, months in sorted(roles.items()):
        def total(role):
            found = [by_month[m] for m in months.get(role, []) if m in by_month]
            return tuple(sum(f[i] for f in found) for i in range(4)) if found else None

        train, valid = total("train"), total("valid")
        if train is None or valid is None:
            continue
        n, _, sxy, sxx = train
        mean, my = sxx[0, 1:] / n, sxy[0] / n
        a, b = sxx[1:, 1:] - n * np.outer(mean, mean), sxy[1:] - n * mean * my
        best = None
        for alpha in alphas:
            w = np.linalg.solve(a + alpha * np.eye(k - 1), b)
            beta = np.concatenate(([my - mean @ w], w))
            mse = (valid[1] - 2 * beta @ valid[2] + beta @ valid[3] @ beta) / valid[0]
            if best is None or mse < best["valid_mse"]:
                best = {"test_year": year, "alpha": alpha, "valid_mse": float(mse), "intercept": float(beta[0]), "coef": dict(zip(xs, map(float, w), strict=True)), "train_rows": int(n), "valid_rows": int(valid[0])}
        out.append(best)
    return out


def ridge_oos(panel: DataFrame, splits: DataFrame, target: str, xs: list[str], *, model: str = "ridge_all", alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """``(model, target, test_year, month, permno, prediction, actual_return)`` of the test months."""
    spark = panel.sparkSession
    fits = ridge_fit(panel, splits, target, xs, alphas=alphas)
    table = spark.createDataFrame([(f["test_year"], (f["intercept"], [f["coef"][x] for x in xs])) for f in fits], "test_year int, ridge_fit struct<b0:double,b:array<double>>")
    tests = split_months(panel, splits, target).where("role = 'test'").join(F.broadcast(table), "test_year")
    rows = panel.where(F.col(target).isNotNull()).join(F.broadcast(tests), "month")  # a row for each month
    fitted = sum((F.col("ridge_fit.b")[i] * F.col(x) for i, x in enumerate(xs)), F.col("ridge_fit.b0"))
    return rows.select(F.lit(model).alias("model"), F.lit(target).alias("target"), "test_year", "month", "permno", fitted.alias("prediction"), F.col(target).alias("actual_return"))


#: Splits whose trees are grown at once; each is a series of small jobs that leave most of a cluster idle.
FITS_AT_ONCE = 4
_PREDICTED = "model string, target string, test_year int, month string, permno long, prediction double, actual_return double"


def _vector(xs: list[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=xs, outputCol="features", handleInvalid="error")


def boosted_models(panel: DataFrame, splits: DataFrame, target: str, xs: list[str], *, rounds: int = 100, depth: int = 5, step: float = 0.1) -> list[tuple[int, object]]:
    """``(test_year, fitted)`` of each split: gradient-boosted trees that stop on the validation months, grown on the cluster.

    The target is winsorised within months; rows without one, or with a null feature, are no examples.
    """
    from pyspark.ml.regression import GBTRegressor

    data = winsorize(panel.where(F.col(target).isNotNull()), ["month"], [target]).select("month", *xs, F.col(target).alias("label")).na.drop()
    data = cut(_vector(xs).transform(data).select("month", "label", "features"))
    months = cut(split_months(panel, splits, target).where("role != 'test'"))

    def fit(year: int):
        role = F.broadcast(months.where(F.col("test_year") == year).select("month", (F.col("role") == "valid").alias("held")))  # rows of months
        trees = GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.85, minInstancesPerNode=20, validationIndicatorCol="held", seed=1729)
        return year, trees.fit(data.join(role, "month").drop("month"))

    years = [r.test_year for r in splits.select("test_year").distinct().orderBy("test_year").collect()]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(fit, years))


def boosted_predict(fits: list[tuple[int, object]], panel: DataFrame, splits: DataFrame, target: str, xs: list[str], *, model: str = "boosted_all") -> DataFrame:
    """``(model, target, test_year, month, permno, prediction, actual_return)`` of the test months; null where a feature is, as with ``ridge_oos``."""
    raw = panel.where(F.col(target).isNotNull()).select("month", "permno", *xs, F.col(target).alias("actual_return"))
    tests = cut(split_months(panel, splits, target).where("role = 'test'"))
    out = panel.sparkSession.createDataFrame([], _PREDICTED)
    whole = reduce(Column.__and__, (F.col(x).isNotNull() for x in xs))
    for year, fitted in fits:
        rows = raw.join(F.broadcast(tests.where(F.col("test_year") == year).select("month")), "month")
        scored = fitted.transform(_vector(xs).transform(rows.where(whole))).select("month", "permno", "prediction", "actual_return")
        scored = scored.unionByName(rows.where(~whole).select("month", "permno", F.lit(None).cast("double").alias("prediction"), "actual_return"))
        out = out.unionByName(scored.select(F.lit(model).alias("model"), F.lit(target).alias("target"), F.lit(year).alias("test_year"), "month", "permno", "prediction", "actual_return"))
    return out


def boosted_oos(panel: DataFrame, splits: DataFrame, target: str, xs: list[str], *, model: str = "boosted_all", rounds: int = 100, depth: int = 5, step: float = 0.1) -> DataFrame:
    """As ``ridge_oos`` with gradient-boosted trees: a fit a split."""
    return boosted_predict(boosted_models(panel, splits, target, xs, rounds=rounds, depth=depth, step=step), panel, splits, target, xs, model=model)


def tree_importance(fits: list[tuple[int, object]], panel: DataFrame, splits: DataFrame, target: str, xs: list[str], *, model: str = "boosted_all") -> DataFrame:
    """``(model, target, test_year, feature, gain, rise)`` of each split's trees.

    gain: the feature's share of what the splits of the trees gained. rise: how much the squared error of the validation months grows when the feature
    takes the values that another stock has in that month; stocks are paired once, by the order of a hash, and each feature is changed alone, so one pass
    scores a row once for each feature and once as it is.
    """
    from pyspark.ml.functions import array_to_vector

    spark = panel.sparkSession
    gains = [(model, target, year, x, float(fitted.featureImportances[i])) for year, fitted in fits for i, x in enumerate(xs)]
    gain = spark.createDataFrame(gains, "model string, target string, test_year int, feature string, gain double")
    months = cut(split_months(panel, splits, target).where("role = 'valid'"))
    rows = panel.where(F.col(target).isNotNull()).select("month", "permno", F.array(*(F.col(x).cast("double") for x in xs)).alias("v"), F.col(target).alias("y")).where(F.size(F.filter("v", F.isnull)) == 0)
    in_month = Window.partitionBy("month")
    rows = rows.withColumns({"i": F.row_number().over(in_month.orderBy("permno")), "j": F.row_number().over(in_month.orderBy(F.xxhash64("permno", "month"), "permno"))})
    pairs = cut(rows.join(rows.select("month", F.col("j").alias("i"), F.col("v").alias("u")), ["month", "i"]).select("month", "v", "u", "y"))
    changed = F.explode(F.expr(f"transform(sequence(-1, {len(xs) - 1}), k -> struct(k as k, transform(v, (x, at) -> if(at = k, u[at], x)) as x))"))
    rises = None
    for year, fitted in fits:
        held = pairs.join(F.broadcast(months.where(F.col("test_year") == year).select("month")), "month")
        scored = fitted.transform(held.select("y", changed.alias("c")).select("y", "c.k", array_to_vector("c.x").alias("features")))
        error = scored.groupBy("k").agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse")).withColumn("test_year", F.lit(year))
        rises = error if rises is None else rises.unionByName(error)
    if rises is None:
        return gain.withColumn("rise", F.lit(None).cast("double"))
    names = spark.createDataFrame(list(enumerate(xs)), "k int, feature string")
    plain = rises.where("k = -1").select("test_year", F.col("mse").alias("plain"))
    rise = rises.join(F.broadcast(names), "k").join(plain, "test_year").select("test_year", "feature", (F.col("mse") - F.col("plain")).alias("rise"))  # a row a split and feature
    return gain.join(rise, ["test_year", "feature"], "left").select("model", "target", "test_year", "feature", "gain", "rise")


def mean_importance(importance: DataFrame) -> DataFrame:
    """``(target, feature, gain, rise, models)``: means over all models and splits, the greatest gain first."""
    return importance.groupBy("target", "feature").agg(F.avg("gain").alias("gain"), F.avg("rise").alias("rise"), F.count_distinct("model").alias("models")).orderBy("target", F.col("gain").desc(), "feature")


def feature_importance(panel: DataFrame, splits: DataFrame, target: str, xs: list[str]) -> DataFrame:
    """Mean size of each feature's ridge coefficient over the splits."""
    rows = [(target, x, abs(c)) for f in ridge_fit(panel, splits, target, xs) for x, c in f["coef"].items()]
    return panel.sparkSession.createDataFrame(rows, "target string, feature string, importance double").groupBy("target", "feature").agg(F.avg("importance").alias("mean_importance"))


def spearman_ic_monthly(predictions: DataFrame, *, least: int = 20) -> DataFrame:
    """Correlation of average ranks of prediction and return in each month with ``least`` rows and some spread."""
    by = ["model", "target", "month"]
    p = predictions.select(*by, "prediction", "actual_return").where("prediction is not null and actual_return is not null")
    p = p.withColumns({"rp": average_rank(by, "prediction"), "ra": average_rank(by, "actual_return")})
    out = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("rp"), F.col("ra")).alias("rank_ic"))
    return out.where((F.col("n") >= least) & F.col("rank_ic").isNotNull())


def decile_spread_monthly(predictions: DataFrame) -> DataFrame:
    """Mean return of the top less the bottom decile by place; null if one is absent."""
    by = ["model", "target", "month"]
    p = predictions.select(*by, "permno", finite(F.col("prediction")).alias("prediction"), finite(F.col("actual_return")).alias("y")).where("prediction is not null and y is not null")
    p = p.withColumn("decile", F.least(F.greatest(F.ceil(rank_share(by, "prediction") * 10), F.lit(1)), F.lit(10)))
    of = lambda d: F.avg(F.when(F.col("decile") == d, F.col("y")))
    return p.groupBy(*by).agg(of(1).alias("low"), of(10).alias("high"), F.count(F.lit(1)).alias("n")).withColumn("high_minus_low", F.col("high") - F.col("low"))


def best_models(evaluation: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` models of greatest mean rank IC for each target, ties by name."""
    w = Window.partitionBy("target").orderBy(F.col("rank_ic_mean").desc_nulls_last(), "model")
    return evaluation.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def oos_eval(predictions: DataFrame) -> DataFrame:
    """A row for each model and target: rank IC and spread with Newey-West t, R2 against zero and share of right signs."""
    by = ["model", "target"]
    ic = newey_west(spearman_ic_monthly(predictions), by, "month", "rank_ic").select(*by, F.col("mean").alias("rank_ic_mean"), F.col("t").alias("rank_ic_nw_t"))
    sp = newey_west(decile_spread_monthly(predictions), by, "month", "high_minus_low").select(*by, F.col("mean").alias("spread_mean"), F.col("t").alias("spread_nw_t"))
    y, p = F.col("actual_return"), F.col("prediction")
    plain = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("oos_rows"), F.count_distinct("month").alias("months"), (1 - F.sum((y - p) * (y - p)) / F.nullif(F.sum(y * y), F.lit(0.0))).alias("r2_vs_zero"), F.avg((F.signum(y) == F.signum(p)).cast("int")).alias("sign_hit_rate")
    )
    return plain.join(ic, by, "left").join(sp, by, "left").withColumn("annualized_spread_approx", annualizer(F.col("target")) * F.col("spread_mean"))
