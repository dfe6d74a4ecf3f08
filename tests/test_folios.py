"""Books in one row for each manager and month: the same stocks and network as from positions, and no position is moved for them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from holdlens.operators import network, ownership
from holdlens.plans import queries
from holdlens.sources.shared import written
from tests.test_books import _monthly, _snap

END = "2021-12-31"


def _made(spark, snap):
    monthly, numbers = _monthly(spark), ownership.stock_numbers(snap)
    return ownership.folios(snap, monthly, F.broadcast(numbers), END), ownership.books(ownership.expand_filings(snap, END), monthly), monthly, F.broadcast(numbers)


def _close(got, want, keys):
    rows = lambda df: {tuple(r[k] for k in keys): r for r in df.select(*want.columns).collect()}
    got, want = rows(got), rows(want)
    assert set(got) == set(want) and len(want) > 0
    for k, row in want.items():
        for a, b in zip(got[k], row, strict=True):
            assert a == (pytest.approx(b, rel=1e-12, abs=1e-15) if isinstance(b, float) else b)


def test_stocks_and_network_are_those_of_positions(spark):
    folios, books, monthly, numbers = _made(spark, _snap(spark))
    stock = ownership.stock_features(books, monthly)
    _close(ownership.stock_features(ownership.held_rows(folios, numbers), monthly), stock, ["month", "permno"])
    w = ownership.weights(books)
    _close(network.folio_degree(folios, numbers), network.network_degree(w), ["month", "permno"])
    _close(network.folio_weighted(folios, numbers, stock), network.network_weighted(w, stock), ["month", "permno"])


def test_a_weight_of_nothing_ties_to_nothing(spark):
    rows = [("a", p, 10 * p, date(2020, 3, 31), date(2020, 5, 12), date(2020, 5, 1), date(2020, 3, 31), "2020Q1", 3.0, v, 0.0) for p, v in ((1, 1e-200), (2, 1e200), (3, 1e200), (70, 5.0))]
    snap = spark.createDataFrame(rows, _snap(spark).schema).where("permno < 70 or manager_id = 'a'")
    folios, books, _, numbers = _made(spark, snap)
    want = network.network_degree(ownership.weights(books).where("portfolio_weight > 0"))
    assert 1 not in {r.permno for r in want.collect()}
    _close(network.folio_degree(folios, numbers), want, ["month", "permno"])


def test_more_securities_than_words(spark, monkeypatch):
    b = queries.Build(spark, "")
    b.folios, books, _, b.numbers = _made(spark, _snap(spark))
    b.books = books
    monkeypatch.setattr(ownership, "FOLIO_WORDS", 0)
    folios, *_ = _made(spark, _snap(spark))
    assert {r.words for r in folios.collect()} == {None}
    _close(b.degree, network.network_degree(ownership.weights(books)), ["month", "permno"])


def test_the_panel_moves_no_position_after_the_books(spark):
    b = queries.Build(spark, "")
    b.folios, b.books, b.monthly, b.numbers = _made(spark, _snap(spark))
    b.folios, b.numbers, b.stock = written(b.folios, "folios"), F.broadcast(written(b.numbers, "numbers")), ownership.stock_features(b.books, b.monthly)
    for df in (b.degree, b.weighted):  # each stock's sums are shuffled, by month and number, and no book is placed or windowed
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(month_date" in plan and "REPARTITION" not in plan and "Window" not in plan


def test_a_code_is_cleaned_once(spark):
    raw = spark.createDataFrame([("m", "c-0000012x9", date(2020, 3, 31), None, 5.0, 1.0), ("m", "12", date(2020, 3, 31), None, 5.0, 1.0)], "mgrno string, cusip string, rdate date, fdate date, shares double, value double")
    held = ownership.clean_holdings(raw, "2020-01-01", "2020-12-31")
    assert held.count() == 1
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]
