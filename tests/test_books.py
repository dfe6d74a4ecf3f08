"""The books of one shuffle by manager against the step-by-step functions."""

from datetime import date

from pyspark.sql import functions as F

from holdlens.operators import network, ownership
from holdlens.plans import queries

SNAP = "manager_id string, permno long, permco long, report_date date, available_date date, available_month date, mapping_date date, report_quarter string, shares double, reported_value double, filing_lag_days double"
#: manager, permno, report, available, value: two filings in a month, a missing report date, a gap, an exit
ROWS = [
    ("a", 1, "2019-12-31", "2020-02-05", 10.0), ("a", 2, "2019-12-31", "2020-02-05", 30.0), ("a", 1, "2019-12-31", "2020-02-20", 7.0), ("a", 3, "2020-03-31", "2020-05-12", 5.0), ("a", 1, "2020-03-31", "2020-05-12", 2.0),
    ("b", 1, None, "2020-02-10", 4.0), ("b", 2, None, "2020-02-10", 6.0), ("b", 2, "2020-03-31", "2020-05-12", 0.0), ("b", 1, "2020-09-30", "2021-01-20", 3.0), ("c", 3, "2020-03-31", "2021-06-01", 1.0),
]


def _d(s):
    return date.fromisoformat(s) if s else None


def _snap(spark):
    data = [(m, p, 10 * p, _d(r), _d(a), _d(a).replace(day=1), _d(r) or _d(a), f"{r[:4]}Q{int(r[5:7]) // 3}" if r else None, 3.0, v, 0.0) for m, p, r, a, v in ROWS]
    return spark.createDataFrame(data, SNAP)


def _monthly(spark):
    rows = [(p, date(2020, m, 1), 0.01 * m, 0.01, 2.0 * p, 1e3, 5.0, 2e3 * p, 0.1, 0.2) for p in (1, 2) for m in range(1, 13)]
    return spark.createDataFrame(rows, "permno long, month_date date, ret double, retx double, prc double, shrout double, vol double, mktcap_proxy double, fwd_ret_1m double, fwd_ret_3m double")


def _sorted(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_months_by_windows_are_those_of_the_join(spark):
    snap = _snap(spark)
    for end in ("2021-12-31", "2021-03-31"):
        want = ownership.expand_positions(snap, ownership.filing_windows(snap, end))
        assert _sorted(ownership.expand_filings(snap, end), want.columns) == _sorted(want, want.columns)
        want = ownership.expand_positions(snap, ownership.filing_windows(snap, end, supersede_same_month=True))
        assert _sorted(ownership.expand_filings(snap, end, supersede_same_month=True), want.columns) == _sorted(want, want.columns)


def test_books_are_positions_with_sales(spark):
    expanded, monthly = ownership.expand_filings(_snap(spark), "2021-12-31"), _monthly(spark)
    want = ownership.sell_pressure(ownership.value_and_weight(expanded, monthly))
    got = ownership.sell_pressure(ownership.with_prices(ownership.books(expanded, monthly), monthly))
    assert set(got.columns) == set(want.columns)
    assert _sorted(got, want.columns) == _sorted(want, want.columns)


def test_a_manager_is_shuffled_once(spark):
    raw = spark.createDataFrame([("m", "c-0000012x9", _d("2020-03-31"), None, 5.0, 1.0)], "mgrno string, cusip string, rdate date, fdate date, shares double, value double")
    names = spark.createDataFrame([(7, "C0000012", "2000-01-01", None, 10)], "permno int, ncusip string, namedt string, nameendt string, shrcd int")
    mapped = ownership.map_point_in_time(ownership.clean_holdings(raw, "2020-01-01", "2020-12-31"), ownership.clean_names(names))
    monthly = spark.createDataFrame(_monthly(spark).collect(), _monthly(spark).schema)
    books = ownership.books(ownership.expand_filings(ownership.snapshot(mapped), "2020-12-31"), F.broadcast(monthly))
    plan = books._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and books.count() == 6


def test_phi_counts_what_was_given_up(spark):
    rows = [("a", 1, 1, 0.5), ("a", 1, 2, 0.5), ("a", 2, 1, 1.0), ("a", 3, 1, 1.0), ("a", 5, 1, 1.0)]
    df = spark.createDataFrame([(date(2020, m, 1), f"2020-{m:02d}", x, p, w) for x, m, p, w in rows], "month_date date, month string, manager_id string, permno long, portfolio_weight double")
    phi = network.manager_phi(df)
    # in February 0.5 went from stock 2 to stock 1: turnover 0.5, concentration 1
    assert {r.month_date.month: r.phi for r in phi.collect()} == {1: 1.0, 2: 1.5, 3: 3.0, 5: 1.0}
    assert network.manager_phi(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_small_months_are_paired_at_once(spark, monkeypatch):
    rows = [("2020-01", f"M{m}", p, 1.0 / (p + 1)) for m in range(3) for p in range(m, 12)]
    df = spark.createDataFrame(rows, "month string, manager_id string, permno long, portfolio_weight double")
    made = []
    pair_sums = network._pair_sums
    monkeypatch.setattr(network, "_pair_sums", lambda *a: made.append(1) or pair_sums(*a))
    got = {(r.i, r.j): r.g for r in network.top_edges(df, top_k=5, block=4).collect()}
    want = {}
    for m in range(3):
        for i in range(m, 12):
            for j in range(i + 1, 12):
                want[i, j] = want.get((i, j), 0.0) + 1 / (i + 1) / (j + 1)
    assert set(got) == set(sorted(want, key=lambda k: (-round(want[k], 12), k))[:5]) and len(made) == 1


def test_codes_are_cleaned_in_the_one_pass_over_holdings(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ownership, "written", lambda df, name: made.append(name) or df)
    day = [_d("2020-03-31"), None, 5.0, 1.0]
    raw = spark.createDataFrame([("m", c, *day) for c in ("c-0000012x9", "C0000012", "12", None, "c0000013")], "mgrno string, cusip string, rdate date, fdate date, shares double, value double")
    got = ownership.clean_holdings(raw, "2020-01-01", "2020-12-31")
    assert not made and {(r.cusip8, r.shares) for r in got.collect()} == {("C0000012", 10.0), ("C0000013", 5.0)}


def test_manager_features_need_no_prices(spark, monkeypatch):
    monthly = _monthly(spark)
    held = ownership.books(ownership.expand_filings(_snap(spark), "2021-12-31"), monthly)
    b = queries.Build(spark, "")
    b.books = held  # no monthly table, whose raw tables would have to be read
    monkeypatch.setattr(queries, "build", lambda *a: b)
    columns = ["month_date", "month", "manager_id", "manager_breadth"]
    want = ownership.manager_features(ownership.with_prices(held, monthly))
    assert _sorted(queries.QUERIES["manager_features"](spark, ""), columns) == _sorted(want, columns)
