"""Quantiles by narrowing against numpy and against Spark's own percentile."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdlens.functions import quantiles
from holdlens.functions.quantiles import exact_quantiles

PS = [0.0, 0.01, 0.05, 0.5, 0.77, 0.95, 0.99, 1.0]
RNG = random.Random(11)
COLUMNS = {
    "uniform": [RNG.random() for _ in range(6000)], "normal": [RNG.gauss(0, 1e6) for _ in range(6000)], "steep": [math.exp(RNG.gauss(0, 40)) for _ in range(6000)],
    "ties": [float(RNG.randrange(4)) for _ in range(6000)], "hot": [7.0 if i % 3 else RNG.random() * 14 for i in range(6000)], "one": [3.5] * 6000, "holes": [None if i % 5 else float(i) for i in range(6000)],
    "few": [None] * 5998 + [1.0, 2.0], "single": [None] * 5999 + [4.0], "none": [None] * 6000, "odd": [float("nan") if i % 2 else -float(i) for i in range(6000)], "outlier": [1e300, -1e300] + [RNG.random() for _ in range(5998)],
}


@pytest.mark.parametrize("few", [8, 100, 20_000])
def test_equal_to_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    names = list(COLUMNS)
    df = spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"`{n}` double" for n in names)).repartition(5).cache()
    got = {(r.name, r.p): r.value for r in exact_quantiles(df, dict.fromkeys(names, PS)).collect()}
    for n, values in COLUMNS.items():
        x = np.array([v for v in values if v is not None and not math.isnan(v)])
        for p in PS:
            if not len(x):
                assert got[n, p] is None
            else:
                assert got[n, p] == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert got["hot", 0.5] == df.agg(F.percentile("hot", F.lit(0.5))).first()[0]


def test_whole_numbers_and_an_empty_table(spark):
    df = spark.range(1001)
    assert [r.value for r in exact_quantiles(df, {"id": [0.5]}).collect()] == [500.0]
    assert [r.value for r in exact_quantiles(df.where("id < 0"), {"id": [0.5, 0.1]}).collect()] == [None, None]


def test_no_task_holds_all_values(spark, monkeypatch):
    """The last sort sees at most ``FEW`` values, and the plan has no aggregate that keeps values."""
    monkeypatch.setattr(quantiles, "FEW", 100)
    out = exact_quantiles(spark.range(50_000).select(F.rand(3).alias("x")).cache(), {"x": [0.5]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile(" not in plan
