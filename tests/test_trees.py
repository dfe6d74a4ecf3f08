"""Boosted trees on a planted step: predictions, importance, and no look at what they are tested on."""

import random

import pytest
from pyspark.sql import functions as F

from holdlens.operators import models

XS = ["step", "noise", "twice"]


def rows(flip_year=None, holes=False):
    rng = random.Random(8)
    out = []
    for year in (1999, 2000, 2001):
        for month in range(1, 13):
            for k in range(40):
                x, z = rng.random(), rng.random()
                y = (0.3 if x > 0.5 else -0.3) + rng.gauss(0, 0.02)
                y = -5 * y if year == flip_year else y
                out.append((f"{year}-{month:02d}", k, None if holes and k == 0 else x, z, 2 * z, y))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    panel = spark.createDataFrame(rows(), "month string, permno long, step double, noise double, twice double, fwd_ret_1m double").cache()
    splits = models.expanding_splits(panel, "fwd_ret_1m", valid=6, min_train=10).cache()
    return panel, splits, models.boosted_models(panel, splits, "fwd_ret_1m", XS, rounds=12, depth=2, step=0.3)


def test_the_step_is_found(fitted):
    panel, splits, fits = fitted
    got = models.boosted_predict(fits, panel, splits, "fwd_ret_1m", XS).join(panel.select("month", "permno", "step"), ["month", "permno"]).collect()
    assert {y for y, _ in fits} == {r.test_year for r in splits.collect()} and len(got) == 480 * len(fits)
    assert all(abs(r.prediction - (0.3 if r.step > 0.5 else -0.3)) < 0.1 for r in got if abs(r.step - 0.5) > 0.05)  # 32 bins


def test_a_tested_year_is_not_seen(spark, fitted):
    panel, splits, fits = fitted
    other = spark.createDataFrame(rows(flip_year=2001), panel.schema)
    again = models.boosted_predict(models.boosted_models(other, splits, "fwd_ret_1m", XS, rounds=12, depth=2, step=0.3), other, splits, "fwd_ret_1m", XS)
    plain = models.boosted_predict(fits, panel, splits, "fwd_ret_1m", XS)
    key = lambda df: {(r.month, r.permno): r.prediction for r in df.where("test_year = 2001").collect()}
    assert key(again) == pytest.approx(key(plain))


def test_importance_puts_the_planted_feature_first(fitted):
    panel, splits, fits = fitted
    made = models.tree_importance(fits, panel, splits, "fwd_ret_1m", XS).collect()
    assert len(made) == len(XS) * len(fits)
    for r in made:
        assert (r.gain > 0.9 and r.rise > 0.05) if r.feature == "step" else (r.gain < 0.1 and abs(r.rise) < 0.005)
    mean = models.mean_importance(models.tree_importance(fits, panel, splits, "fwd_ret_1m", XS)).collect()
    assert mean[0].feature == "step" and mean[0].models == 1


def test_rows_without_a_feature_have_no_prediction(spark, fitted):
    panel, splits, fits = fitted
    holed = spark.createDataFrame(rows(holes=True), panel.schema)
    got = models.boosted_predict(fits, holed, splits, "fwd_ret_1m", XS)
    assert {r.permno for r in got.where("prediction is null").collect()} == {0} and got.count() == 480 * len(fits)
    assert got.where(F.col("permno") == 0).where("prediction is not null").count() == 0


def test_no_splits(spark, fitted):
    panel, splits, _ = fitted
    none = splits.where("test_year < 0")
    assert models.boosted_models(panel, none, "fwd_ret_1m", XS) == [] and models.boosted_predict([], panel, none, "fwd_ret_1m", XS).count() == 0
    assert models.tree_importance([], panel, none, "fwd_ret_1m", XS).count() == 0
