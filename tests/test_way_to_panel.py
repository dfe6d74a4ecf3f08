"""The way from holdings to the panel: parts grow with the rows, and positions move once where they must."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from holdlens.operators import network, ownership
from holdlens.sources import shared
from tests.test_books import _monthly, _snap

RAW = "mgrno string, cusip string, rdate date, fdate date, shares double, value double"


def test_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 10)
    raw = spark.createDataFrame([(f"m{k}", "c-0000012x9", date(2020, 3, 31), None, 5.0, 1.0) for k in range(60)], RAW)
    got = ownership.clean_holdings(raw, "2020-01-01", "2020-12-31")
    assert got.count() == 60 and got.rdd.getNumPartitions() == 60  # 10 for each row, in parts of 10
    few = ownership.clean_holdings(raw.limit(1), "2020-01-01", "2020-12-31")
    assert few.count() == 1 and few.rdd.getNumPartitions() == shared.SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stock_features_of_books_need_no_prices_of_positions(spark):
    monthly = _monthly(spark)
    held = ownership.books(ownership.expand_filings(_snap(spark), "2021-12-31"), monthly)
    want = ownership.stock_features(ownership.sell_pressure(ownership.with_prices(held, monthly)))
    made = ownership.stock_features(held, monthly)
    assert made.columns == want.columns
    key = lambda df: {(r.month, r.permno): [v if isinstance(v, float) else repr(v) for v in r] for r in df.collect()}
    got, plain = key(made), key(want)
    assert set(got) == set(plain) and {p for _, p in got} == {1, 2, 3}  # stock 3 has no prices
    for k, row in plain.items():
        assert [v for v in got[k] if isinstance(v, str)] == [v for v in row if isinstance(v, str)]
        assert [v for v in got[k] if isinstance(v, float)] == pytest.approx([v for v in row if isinstance(v, float)], rel=1e-12)


def test_weights_of_a_month_move_once_before_the_stocks_sums(spark):
    w = spark.createDataFrame([("2020-01", m, p, 0.1 * p) for m in "abc" for p in range(1, 5)], "month string, manager_id string, permno long, portfolio_weight double")
    stock = spark.createDataFrame([("2020-01", p, 0.1 * p) for p in range(1, 4)], "month string, permno long, stock_sell_pressure double")
    out = network.network_weighted(w, F.broadcast(stock))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(month") == 2 and "REPARTITION_BY_NUM" in plan
    assert {r.permno: round(r.network_weighted_degree, 12) for r in out.collect()} == {p: round(3 * 0.1 * p * (1.0 - 0.1 * p), 12) for p in range(1, 5)}


def test_small_tables_are_broadcast_whatever_the_threshold(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(5)
        plan = lambda: a.join(shared.small(spark.range(3)), "id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan()
        monkeypatch.setattr(shared, "SMALL_ROWS", 2)
        assert "ShuffledHashJoin" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
