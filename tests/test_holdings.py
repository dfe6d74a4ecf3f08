from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdlens.functions.stats import newey_west
from holdlens.operators import econometrics, models, network, ownership, portfolio, robustness, signals


def _d(s):
    return date.fromisoformat(s) if s else None


def _snapshot(spark, rows):
    """(manager, permno, report, available)"""
    data = [(m, p, p, _d(r), _d(a), _d(a).replace(day=1), _d(r) or _d(a), "q", 1.0, 10.0, 0.0) for m, p, r, a in rows]
    return spark.createDataFrame(data, "manager_id string, permno long, permco long, report_date date, available_date date, available_month date, mapping_date date, report_quarter string, shares double, reported_value double, filing_lag_days double")


def test_filing_windows(spark):
    snap = _snapshot(spark, [("a", 1, "2019-12-31", "2020-02-05"), ("a", 2, "2019-12-31", "2020-02-05"), ("a", 1, "2019-12-31", "2020-02-20"), ("b", 1, "2019-12-31", "2020-02-10"), ("b", 1, "2020-03-31", "2020-05-12")])
    w = ownership.filing_windows(snap, "2020-12-31")
    got = {(r.manager_id, str(r.available_date)): (str(r.active_start_month), str(r.active_end_month)) for r in w.collect()}
    assert got[("b", "2020-02-10")] == ("2020-02-01", "2020-04-01")
    assert got[("b", "2020-05-12")] == ("2020-05-01", "2020-10-01")
    assert got[("a", "2020-02-05")] == got[("a", "2020-02-20")] == ("2020-02-01", "2020-07-01")
    held = {str(r.month_date) for r in ownership.expand_positions(snap, w).where("manager_id = 'a' and permno = 2").collect()}
    assert max(held) == "2020-07-01"
    kept = ownership.filing_windows(snap, "2020-12-31", supersede_same_month=True)
    assert kept.where("manager_id = 'a'").count() == 1


def test_clean_and_map(spark):
    raw = spark.createDataFrame([("m", "c-0000012x9", _d("2020-03-31"), None, 5.0, None), ("m", "c-0000012x9", None, _d("2020-05-10"), 1.0, 2.0), ("m", "zz", _d("2020-03-31"), None, 5.0, 1.0)], "mgrno string, cusip string, rdate date, fdate date, shares double, value double")
    h = ownership.clean_holdings(raw, "2020-01-01", "2020-12-31")
    assert {(str(r.available_date), str(r.mapping_date), r.reported_value) for r in h.collect()} == {("2020-05-15", "2020-03-31", 0.0), ("2020-05-10", "2020-05-10", 2.0)}
    names = spark.createDataFrame([(7, "C0000012", "2000-01-01", None, 31), (8, "C0000012", "1990-01-01", None, 10)], "permno int, ncusip string, namedt string, nameendt string, shrcd int")
    assert {r.permno for r in ownership.map_point_in_time(h, ownership.clean_names(names)).collect()} == {8}
    assert ownership.map_point_in_time(h, ownership.clean_names(names.where("permno = 7"))).count() == 0


def test_forward_returns_skip_gaps(spark):
    m = spark.createDataFrame([(1, _d("2020-01-31"), 0.1), (1, _d("2020-02-28"), 0.2), (1, _d("2020-04-30"), 0.4)], "permno long, date date, ret double")
    got = {r.month: r.fwd_ret_1m for r in ownership.forward_returns(ownership.clean_monthly(m)).collect()}
    assert got == {"2020-01": 0.2, "2020-02": 0.4, "2020-04": None}
    assert {r.month: r.fwd_ret_1m for r in ownership.forward_returns(ownership.clean_monthly(m), calendar_strict=True).collect()}["2020-02"] is None


def test_network(spark):
    held = [("north", 11, 0.7), ("north", 12, 0.3), ("south", 12, 0.2), ("south", 14, 0.8), ("east", 19, 1.0)]
    pos = spark.createDataFrame([("1998-06", *h) for h in held], "month string, manager_id string, permno long, portfolio_weight double")
    stock = spark.createDataFrame([("1998-06", 11, 0.4), ("1998-06", 12, 0.0), ("1998-06", 14, 0.1)], "month string, permno long, stock_sell_pressure double")
    assert {(r.i, r.j): round(r.g, 9) for r in network.common_ownership_edges(pos).collect()} == {(11, 12): 0.21, (12, 14): 0.16}
    assert {r.permno: r.network_degree for r in network.network_degree(pos).collect()} == {11: 1, 12: 2, 14: 1, 19: 0}
    w = {r.permno: (round(r.network_weighted_degree, 7), round(r.network_peer_sell_pressure, 7)) for r in network.network_weighted(pos, stock).collect()}
    # the peers of 12 weigh 0.21 and 0.16: (0.21 * 0.4 + 0.16 * 0.1) / 0.37
    assert w == {11: (0.21, 0.0), 12: (0.37, 0.2702703), 14: (0.16, 0.0), 19: (0.0, 0.0)}


def test_newey_west(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    df = spark.createDataFrame([("two", i, float(v)) for i, v in enumerate([1, 3])] + [("many", i, float(v)) for i, v in enumerate(x)] + [("one", 0, 1.0)], "g string, t int, x double")
    got = {r.g: r for r in newey_west(df, ["g"], "t", "x").collect()}
    assert (got["two"].se, got["two"].t) == (0.5, 4.0)
    assert got["one"].se is None and got["one"].mean == 1.0
    d = x - x.mean()
    var = d @ d / 40 + sum(2 * (1 - k / 7) * (d[k:] @ d[:-k]) / 40 for k in range(1, 7))
    assert got["many"].se == pytest.approx((var / 40) ** 0.5)


def _predictions(spark, months=3, n=20):
    rng = np.random.default_rng(3)
    rows = [("m", "fwd_ret_1m", f"2020-{k:02d}", i, float(rng.normal()), float(rng.normal())) for k in range(1, months + 1) for i in range(n)]
    return spark.createDataFrame(rows, "model string, target string, month string, permno long, prediction double, actual_return double")


def test_portfolio(spark):
    p = portfolio.build_portfolio(_predictions(spark)).orderBy("month").collect()
    assert (p[0].n_long, p[0].n_short, p[0].turnover_abs_change, p[0].turnover_one_way) == (3, 2, pytest.approx(1.0), pytest.approx(0.5))
    assert p[0].gross_exposure == pytest.approx(1) and p[0].net_exposure == pytest.approx(0)
    assert p[1].net_return_10bps == pytest.approx(p[1].gross_dollar_neutral_return - 0.001 * p[1].turnover_abs_change)


def test_drawdown(spark):
    s = spark.createDataFrame([("a", "1", -0.1), ("a", "2", 0.05), ("b", "1", 0.1), ("b", "2", -0.5), ("b", "3", 0.2)], "g string, month string, r double")
    got = {r.g: r for r in portfolio.max_drawdown(s, ["g"]).collect()}
    assert got["a"].max_drawdown == 0
    assert (round(got["b"].max_drawdown, 9), got["b"].peak, got["b"].trough) == (-0.5, "1", "2")


def test_constant_feature_has_no_ic(spark):
    long = spark.createDataFrame([("f", "t", "2020-01", i, 1.0, float(i)) for i in range(10)], "feature string, target string, month string, permno long, x double, y double")
    assert signals.rank_ic_monthly(long, least=5).first().rank_ic is None


def test_fama_macbeth_and_hac_match_direct_solutions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([("g", "2020-01", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x[:, 0], x[:, 1], y, strict=True))], "g string, month string, t int, a double, b double, y double")
    full = np.column_stack((np.ones(60), x))
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    got = {r.variable: r.coef for r in econometrics.fama_macbeth(df, "y", ["a", "b"]).collect()}
    assert [got["const"], got["a"], got["b"]] == pytest.approx(list(beta))
    u = full * (y - full @ beta)[:, None]
    s = u.T @ u + sum((1 - k / 7) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, 7))
    bread = np.linalg.inv(full.T @ full)
    t = beta / np.sqrt(np.diag(bread @ s @ bread))
    hac = {r.variable: r.t for r in econometrics.hac_regression(df, ["g"], "t", "y", ["a", "b"]).collect()}
    assert [hac["const"], hac["a"], hac["b"]] == pytest.approx(list(t))


def test_ridge_is_the_direct_solution(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{2000 + k // 12}-{k % 12 + 1:02d}", i, float(rng.normal()), float(rng.normal()), float(rng.normal())) for k in range(36) for i in range(5)]
    panel = spark.createDataFrame(rows, "month string, permno long, a double, b double, fwd_ret_1m double")
    splits = models.expanding_splits(panel, "fwd_ret_1m", valid=6, min_train=12)
    assert [(r.test_year, r.first_test, r.valid_end, r.valid_start, r.train_end) for r in splits.orderBy("test_year").collect()] == [(2002, 24, 23, 17, 16)]
    fit = models.ridge_fit(panel, splits, "fwd_ret_1m", ["a", "b"], alphas=(3.0,))[0]
    months = sorted({r[0] for r in rows})
    from holdlens.functions.stats import winsorize

    data = np.array([(r.a, r.b, r.fwd_ret_1m) for r in winsorize(panel, ["month"], ["fwd_ret_1m"]).where(F.col("month").isin(months[:16])).collect()])
    xc, yc = data[:, :2] - data[:, :2].mean(0), data[:, 2] - data[:, 2].mean()
    assert list(fit["coef"].values()) == pytest.approx(list(np.linalg.solve(xc.T @ xc + 3 * np.eye(2), xc.T @ yc)))
    assert models.ridge_oos(panel, splits, "fwd_ret_1m", ["a", "b"]).count() == 60


def test_placebo_only_reorders(spark):
    p = _predictions(spark)
    q = robustness.permuted_returns(p)
    assert sorted(r[0] for r in q.select("placebo_return").collect()) == sorted(r[0] for r in p.select("actual_return").collect())
    assert q.where("placebo_return != actual_return").count() > 40
