"""Logistic fits against a numpy optimum, areas against all pairs, and the managers' phi by hand."""

import datetime as dt
import random

import numpy as np
import pytest

from holdlens.operators import downside, models, network

XS = ["a", "b"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(6)
    rows = []
    for year in (1999, 2000, 2001):
        for month in range(1, 13):
            for k in range(40):
                a, b = rng.gauss(0, 1), rng.gauss(0, 1)
                rows.append((f"{year}-{month:02d}", k, a, None if k == 39 else b, -a + 0.3 * b + rng.gauss(0, 1) if k != 38 else None))
    return spark.createDataFrame(rows, "month string, permno long, a double, b double, fwd_ret_1m double").cache()


def optimum(x, y, ridge):
    b = np.zeros(x.shape[1])
    pen = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ b)
    return b


def test_fits_equal_the_optimum_and_see_no_later_month(panel):
    labelled = downside.downside_labels(panel, "fwd_ret_1m").cache()
    splits = models.expanding_splits(panel, "fwd_ret_1m", valid=6, min_train=10).cache()
    fits = downside.logistic_fit(labelled, splits, "fwd_ret_1m", XS)
    data = labelled.toPandas().dropna(subset=XS)
    months = sorted(panel.select("month").distinct().toPandas().month)
    assert set(fits) == {r.test_year for r in splits.collect()} and fits
    for r in splits.collect():
        rows = data[data.month.isin(months[: r.train_end])]
        want = optimum(np.column_stack((np.ones(len(rows)), rows[XS])), rows.downside.to_numpy(), 1.0)
        assert fits[r.test_year] == pytest.approx(want, rel=1e-6)
        assert want[1] > 0.5
    made = downside.logistic_oos(labelled, splits, "fwd_ret_1m", XS)
    assert {r.permno for r in made.where("prediction is null").collect()} == {39}
    assert downside.auc_summary(downside.auc_monthly(made)).first().mean_auc > 0.7
    none = splits.where("test_year < 0")
    assert downside.logistic_fit(labelled, none, "fwd_ret_1m", XS) == {} and downside.logistic_oos(labelled, none, "fwd_ret_1m", XS).count() == 0


def test_labels_are_a_tenth_of_each_month(panel):
    got = downside.downside_labels(panel, "fwd_ret_1m").groupBy("month").agg({"downside": "sum", "permno": "count"}).collect()
    assert {(r["sum(downside)"], r["count(permno)"]) for r in got} == {(3, 39)}


def test_areas_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [("m", "t", f"2001-{m:02d}", float(rng.randrange(4)), int(rng.random() < 0.3)) for m in range(1, 7) for _ in range(30)] + [("m", "t", "2002-01", 1.0, 1), ("m", "t", "2001-01", None, 1)]
    got = {r.month: r.auc for r in downside.auc_monthly(spark.createDataFrame(rows, "model string, target string, month string, prediction double, downside int")).collect()}
    for month in {r[2] for r in rows}:
        up = [r[3] for r in rows if r[2] == month and r[4] and r[3] is not None]
        down = [r[3] for r in rows if r[2] == month and not r[4]]
        want = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)) if up and down else None
        assert got.get(month) == (pytest.approx(want) if want is not None else None)


def test_phi_by_hand(spark):
    d = lambda m: dt.date(2001, m, 1)
    rows = [(d(1), "A", 1, 0.5), (d(1), "A", 2, 0.5), (d(2), "A", 1, 1.0), (d(3), "A", 1, 1.0), (d(5), "A", 1, 1.0), (d(3), "B", 1, 1.0)]
    df = spark.createDataFrame(rows, "month_date date, manager_id string, permno long, portfolio_weight double")
    got = {(r.month_date.month, r.manager_id): r.phi for r in network.manager_phi(df).collect()}
    # February turned over half of its weight, and was all one stock
    assert got == {(1, "A"): 1.0, (2, "A"): 1.5, (3, "A"): 3.0, (5, "A"): 1.0, (3, "B"): 1.0}
