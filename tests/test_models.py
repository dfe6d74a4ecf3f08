"""Registered models against direct solutions on the same tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdlens.operators import econometrics as eco
from holdlens.operators import models
from holdlens.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def build(spark):
    return queries.build(spark, SF)


def test_feature_sets():
    sets = models.feature_sets(["z_owner_hhi", "z_stock_sell_pressure", "z_network_degree", "z_owner_hhi_x_z_network_degree"])
    assert sets["no_network"] == ["z_owner_hhi", "z_stock_sell_pressure"]
    assert sets["network_pressure"] == ["z_stock_sell_pressure", "z_network_degree", "z_owner_hhi_x_z_network_degree"]


def test_splits_need_rows(build):
    splits = build.splits.where("target = 'fwd_ret_1m'")
    assert models.enough_rows(build.panel, splits, "fwd_ret_1m", (1, 1, 1)).count() == splits.count() > 0
    assert models.enough_rows(build.panel, splits, "fwd_ret_1m", (1, 1, 10**6)).count() == 0


def test_fama_macbeth_of_the_panel(build):
    xs = ["z_owner_hhi", "z_stock_sell_pressure", "z_vol"]
    got = {}
    for r in eco.fama_macbeth(build.winsorized_z, "fwd_ret_1m", xs, least=30, per_regressor=4).collect():
        got.setdefault(r.month, {})[r.variable] = r.coef
    data = build.winsorized_z.select("month", "fwd_ret_1m", *xs).na.drop().toPandas()
    want = {m: g for m, g in data.groupby("month") if len(g) >= 30}
    assert set(got) == set(want) and got
    for m, g in want.items():
        beta = np.linalg.lstsq(np.column_stack((np.ones(len(g)), g[xs])), g.fwd_ret_1m, rcond=None)[0]
        assert [got[m][v] for v in ("const", *xs)] == pytest.approx(list(beta), rel=1e-6, abs=1e-9)


def test_hac_of_the_portfolio(build):
    df = build.folio.join(build.factors, "month")
    got = {(r.model, r.target, r.variable): (r.coef, r.t) for r in eco.hac_regression(df, ["model", "target"], "month", "gross_dollar_neutral_return", ["mktrf"]).collect()}
    data = df.select("model", "target", "month", "gross_dollar_neutral_return", "mktrf").na.drop().orderBy("month").toPandas()
    for (model, target), g in data.groupby(["model", "target"]):
        x, y = np.column_stack((np.ones(len(g)), g.mktrf)), g.gross_dollar_neutral_return.to_numpy()
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        u = x * (y - x @ beta)[:, None]
        s = u.T @ u + sum((1 - k / 7) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, 7))
        bread = np.linalg.inv(x.T @ x)
        t = beta / np.sqrt(np.diag(bread @ s @ bread))
        for i, v in enumerate(("const", "mktrf")):
            assert got[model, target, v] == pytest.approx((beta[i], t[i]), rel=1e-6)


def test_ridge_of_the_panel(build):
    target, xs = "fwd_ret_1m", build.model_features
    splits = build.splits_of(target)
    fit = models.ridge_fit(build.features_z, splits, target, xs)[0]
    months = models.split_months(build.features_z, splits, target).where((F.col("test_year") == fit["test_year"]) & (F.col("role") == "test"))
    rows = build.features_z.where(F.col(target).isNotNull()).join(months, "month").select("month", "permno", *xs).toPandas()
    want = fit["intercept"] + rows[xs].to_numpy() @ np.array([fit["coef"][x] for x in xs])
    made = build.ridge.where((F.col("target") == target) & (F.col("model") == "ridge_all") & (F.col("test_year") == fit["test_year"])).select("month", "permno", "prediction").toPandas()
    both = rows[["month", "permno"]].assign(want=want).merge(made, on=["month", "permno"])
    assert len(both) == len(rows) == len(made) > 0 and np.allclose(both.want, both.prediction)


def test_views_of_summaries(spark):
    rows = [("s", "fwd_ret_1m", f"z{k}", float((-1) ** k * k)) for k in range(14)] + [("s", "fwd_ret_3m", "z99", 99.0), ("s", "fwd_ret_1m", "const", 50.0)]
    out = eco.strongest(spark.createDataFrame(rows, "spec string, target string, variable string, nw_t double"), target="fwd_ret_1m", controls=["z13"]).collect()
    assert [r.variable for r in out] == [f"z{k}" for k in range(12, 2, -1)]
