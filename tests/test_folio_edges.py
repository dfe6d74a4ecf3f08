"""Heaviest edges by squares of a month's weights: those of all pairs, and no position is dealt for them."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from holdlens.operators import network, ownership
from holdlens.plans import queries
from holdlens.sources import sample, shared
from tests.test_books import _monthly, _snap
from tests.test_folios import END, _close, _made


def _many(spark):
    """Managers with filings of a month, of two in a month and with gaps."""
    rng, rows = random.Random(5), []
    for m in range(12):
        for year, month, day in sorted({(2020, rng.randrange(1, 13), rng.randrange(1, 28)) for _ in range(5)}):
            at = date(year, month, day)
            rows += [(f"m{m}", p, 10 * p, date(2019, 12, 31), at, at.replace(day=1), at, "2019Q4", 3.0, rng.choice([0.0, 1.0, 2.5, 7.0]), 0.0) for p in rng.sample(range(1, 30), rng.randrange(1, 9))]
    return spark.createDataFrame(rows, _snap(spark).schema)


@pytest.mark.parametrize("cells", [1, 100, 1 << 22])
def test_edges_are_those_of_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(network, "CELLS", cells)  # a month's rows, and a manager's, lie in several matrices
    folios, books, _, numbers = _made(spark, _many(spark))
    w = ownership.weights(books)
    _close(network.folio_edges(folios, numbers), network.common_ownership_edges(w), ["month", "i", "j"])
    want = network.common_ownership_edges(network.with_phi(w), phi=F.col("phi"))
    _close(network.folio_edges(folios, numbers, lagged=True), want, ["month", "i", "j"])
    top = network.top_edges(network.with_phi(w), top_k=7, phi=F.col("phi"))
    _close(network.folio_top_edges(folios, numbers, top_k=7, lagged=True), top, ["month", "rank"])


def test_parts_grow_with_rows(spark, monkeypatch):
    folios, _, _, numbers = _made(spark, _snap(spark))
    plan = lambda: network.folio_edges(folios, numbers, rows=50)._jdf.queryExecution().executedPlan().toString()
    assert ", 16), REPARTITION_BY_NUM" in plan()
    monkeypatch.setattr(shared, "PART_ROWS", 1)
    assert ", 50), REPARTITION_BY_NUM" in plan()


def test_a_weight_of_nothing_and_no_row(spark):
    rows = [("a", p, 10 * p, date(2020, 3, 31), date(2020, 5, 12), date(2020, 5, 1), date(2020, 3, 31), "2020Q1", 3.0, v, 0.0) for p, v in ((1, 1e-200), (2, 1e200), (3, 1e-60), (70, 1e-50))]
    folios, books, _, numbers = _made(spark, spark.createDataFrame(rows, _snap(spark).schema))
    want = network.common_ownership_edges(ownership.weights(books))  # a product of two small weights is 0, and an edge all the same
    assert want.count() == 3 * 6 and want.where("g = 0").count() > 0
    _close(network.folio_edges(folios, numbers), want, ["month", "i", "j"])
    assert network.folio_edges(folios.where("false"), numbers, lagged=True).count() == 0


def test_the_query_needs_no_books(spark, monkeypatch):
    b = queries.Build(spark, "")
    snap, b.monthly = _many(spark), _monthly(spark)
    b.snap, b.trades, b.numbers, made = snap, snap, F.broadcast(ownership.stock_numbers(snap)), []
    monkeypatch.setattr(sample, "END", END)
    monkeypatch.setattr(network, "written", lambda df, name: made.append(name) or df)
    monkeypatch.setattr(ownership, "written", lambda df, name: made.append(name) or df)
    out = b.phi_top_edges(500)
    assert not made and "books" not in vars(b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # managers are placed, then their months' rows are dealt, then sums
    assert plan.count("MapInArrow") == 2 and "hashpartitioning(month_date" in plan
    monkeypatch.setattr(ownership, "FOLIO_WORDS", 0)
    b.books = ownership.books(ownership.expand_filings(snap, END), b.monthly)
    _close(out.drop("rank"), b.phi_top_edges(500).drop("rank"), ["month", "i", "j"])
    # multiplied in the order of SQL, so that ranks of weights near a half of the last decimal are its own; roots of phi, as above, put some of these elsewhere
    w = network.with_phi(ownership.weights(b.books)).select("month", "manager_id", "permno", "phi", F.col("portfolio_weight").alias("w"))
    pairs = w.alias("a").join(w.alias("b"), ["month", "manager_id"]).where("a.permno < b.permno").groupBy("month", F.col("a.permno").alias("i"), F.col("b.permno").alias("j"))
    _close(out, network._ranked(pairs.agg(F.sum(F.expr("a.phi * a.w * b.w")).alias("g")), 500), ["month", "i", "j"])
