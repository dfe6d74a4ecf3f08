"""Who falls: labels of the worst returns of each month, expanding logistic fits and ranked areas under the curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdlens.functions.columns import finite
from holdlens.functions.stats import average_rank, newey_west, rank_share
from holdlens.operators.models import split_months
from holdlens.sources.shared import cut

#: Share of a month's stocks that count as falls.
WORST = 0.1


def downside_labels(panel: DataFrame, target: str, *, worst: float = WORST) -> DataFrame:
    """``panel`` rows with a finite ``target`` and their ``downside``: 1 for the ``worst`` share of a month by place, ties by permno, else 0."""
    rows = panel.withColumn("y", finite(F.col(target))).where("y is not null")
    return rows.withColumn("downside", (rank_share(["month"], "y") <= worst).cast("int")).drop("y")


def _newton_sums(examples: DataFrame, beta: dict[int, np.ndarray], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient and weighted products of each split at ``beta``: a task adds up its batches, and the cluster the tasks."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            years = batch.column("test_year").to_numpy()
            y = batch.column("downside").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, k)
            for year in np.unique(years):
                at = years == year
                xs = x[at]
                p = 1 / (1 + np.exp(-np.clip(xs @ beta[int(year)], -500, 500)))
                both = np.concatenate((xs.T @ (y[at] - p), ((xs * (p * (1 - p))[:, None]).T @ xs).ravel()))
                total[int(year)] = total.get(int(year), 0.0) + both
        for year, both in total.items():
            yield pa.record_batch([pa.array([year] * len(both), pa.int32()), pa.array(range(len(both)), pa.int32()), pa.array(both)], ["test_year", "place", "part"])

    parts = examples.mapInArrow(run, "test_year int, place int, part double").groupBy("test_year", "place").agg(F.sum("part").alias("part"))
    out = {y: np.zeros(k + k * k) for y in beta}
    seen = set()
    for r in parts.toLocalIterator():  # k * (k + 1) numbers a split
        out[r.test_year][r.place] = r.part
        seen.add(r.test_year)
    return {y: (v[:k], v[k:].reshape(k, k)) for y, v in out.items() if y in seen}


def logistic_fit(labelled: DataFrame, splits: DataFrame, target: str, xs: list[str], *, ridge: float = 1.0, rounds: int = 30, close: float = 1e-9) -> dict[int, np.ndarray]:
    """Constant and coefficients of each split's training months, by Newton steps with a ridge penalty on all but the constant.

    All splits take a step at once: one pass sums gradients and weighted products of each split, and only these reach the driver.
    Rows with a null among ``xs`` are no examples. Training months come before the split's embargo, so no later month is seen.
    """
    spark, k = labelled.sparkSession, len(xs) + 1
    months = split_months(labelled, splits, target).where("role = 'train'").select("test_year", "month")
    rows = cut(labelled.select("month", F.col("downside").cast("double").alias("downside"), F.array(F.lit(1.0), *(F.col(x).cast("double") for x in xs)).alias("x")).where(F.size(F.filter("x", F.isnull)) == 0))
    beta = {r.test_year: np.zeros(k) for r in splits.select("test_year").distinct().collect()}
    examples = cut(rows.join(F.broadcast(months), "month").select("test_year", "downside", "x"))
    penalty = ridge * np.diag([0.0, *[1.0] * (k - 1)])
    for _ in range(rounds if beta else 0):
        moved, sums = 0.0, _newton_sums(examples, beta, k)
        for year, (g, h) in sums.items():
            step = np.linalg.lstsq(h + penalty, g - penalty @ beta[year], rcond=None)[0]
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # a first step may be too long
            beta[year] = beta[year] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < close:
            break
        beta = {y: b for y, b in beta.items() if y in sums}  # splits without examples have no fit
    return beta


def logistic_oos(labelled: DataFrame, splits: DataFrame, target: str, xs: list[str], *, model: str = "logistic_all", **options) -> DataFrame:
    """``(model, target, test_year, month, permno, prediction, downside)`` of the test months; null where a feature is."""
    fits = logistic_fit(labelled, splits, target, xs, **options)
    table = labelled.sparkSession.createDataFrame([(y, b.tolist()) for y, b in fits.items()], "test_year int, beta array<double>")
    tests = split_months(labelled, splits, target).where("role = 'test'").join(F.broadcast(table), "test_year")
    rows = labelled.join(F.broadcast(tests), "month")
    eta = sum((F.col("beta")[i] * F.col(x) for i, x in enumerate(xs, 1)), F.col("beta")[0])
    return rows.select(F.lit(model).alias("model"), F.lit(target).alias("target"), "test_year", "month", "permno", (1 / (1 + F.exp(-eta))).alias("prediction"), "downside")


def auc_monthly(scored: DataFrame) -> DataFrame:
    """``(model, target, month, n, falls, auc)`` of ``scored(model, target, month, prediction, downside)``: how often a fall is scored above another stock, ties half; months with both."""
    by = ["model", "target", "month"]
    rows = scored.where("prediction is not null and downside is not null").withColumn("rank", average_rank(by, "prediction"))
    one = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("downside").alias("falls"), F.sum(F.col("rank") * F.col("downside")).alias("ranks")).where("falls > 0 and falls < n")
    return one.select(*by, "n", "falls", ((F.col("ranks") - F.col("falls") * (F.col("falls") + 1) / 2) / (F.col("falls") * (F.col("n") - F.col("falls")))).alias("auc"))


def auc_summary(monthly: DataFrame) -> DataFrame:
    """``(model, target, months, mean_auc, excess_t)``: the mean area and the Newey-West t of what it has above one half."""
    nw = newey_west(monthly.withColumn("excess", F.col("auc") - 0.5), ["model", "target"], "month", "excess")
    return nw.select("model", "target", F.col("n").alias("months"), (F.col("mean") + 0.5).alias("mean_auc"), F.col("t").alias("excess_t"))
