"""Pruned heaviest edges and degrees against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from holdlens.operators import network

SCHEMA = "month string, manager_id string, permno long, portfolio_weight double"


def book(months=2, managers=40, stocks=150, seed=3, steep=True):
    """Weights of eighths, so that many edges tie; few stocks are held by many managers."""
    rng = random.Random(seed)
    rows = []
    for m in range(months):
        for a in range(managers):
            held = {min(stocks - 1, int(rng.expovariate(0.08))) if steep else rng.randrange(stocks) for _ in range(rng.randrange(1, 30))}
            rows += [(f"2001-{m + 1:02d}", f"M{a}", s, rng.choice([0.125, 0.25, 0.5]) / (1 + (s // 4 if steep else 0))) for s in held]
    return rows


def edges(rows):
    out = {}
    by = {}
    for month, manager, stock, w in rows:
        if w > 0:
            by.setdefault((month, manager), []).append((stock, w))
    for (month, _), held in by.items():
        for i, wi in held:
            for j, wj in held:
                if i < j:
                    out[month, i, j] = out.get((month, i, j), 0.0) + wi * wj
    return out


@pytest.mark.parametrize("top_k, block, steep", [(20, 4, True), (20, 32, True), (300, 8, False), (100_000, 8, True), (1, 4, False)])
def test_heaviest_edges_are_those_of_all_pairs(spark, top_k, block, steep):
    rows = book(steep=steep) + [("2001-01", "M0", 149, 0.0)]
    got = network.top_edges(spark.createDataFrame(rows, SCHEMA), top_k=top_k, block=block).collect()
    want = []
    for month in ("2001-01", "2001-02"):
        ordered = sorted((-round(g, network.TIE_DECIMALS), i, j) for (m, i, j), g in edges(rows).items() if m == month)
        want += [(month, i, j, k) for k, (_, i, j) in enumerate(ordered[:top_k], 1)]
    assert sorted((r.month, r.i, r.j, r["rank"]) for r in got) == sorted(want)
    assert all(abs(r.g - edges(rows)[r.month, r.i, r.j]) < 1e-9 for r in got)


def test_most_pairs_are_pruned(spark):
    rows = book(months=1, managers=200, stocks=400)
    held, pairs = network.block_pairs(spark.createDataFrame(rows, SCHEMA), top_k=20, block=4)
    blocks = held.agg(F.max("block")).first()[0] + 1
    assert pairs.count() < 0.25 * blocks * (blocks + 1) / 2
    made = held.join(pairs, (held["month"] == pairs["month"]) & (held["block"] == pairs["a"])).select("manager_id", "place", "b").join(held.select("manager_id", F.col("place").alias("other"), F.col("block").alias("b")), ["manager_id", "b"]).where("place < other").count()
    by_manager = held.groupBy("manager_id").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert made < 0.6 * by_manager


def degrees(rows):
    out = {}
    for month, _, stock, w in rows:
        if w > 0:
            out.setdefault((month, stock), set())
    for month, i, j in edges(rows):
        out[month, i].add(j)
        out[month, j].add(i)
    return {k: len(v) for k, v in out.items()}


def test_degrees_exact_and_by_sketches(spark):
    rows = book(stocks=300, steep=False) + [("2001-03", "alone", 7, 1.0), ("2001-03", "none", 8, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = degrees(rows)
    assert {(r.month, r.permno): r.network_degree for r in network.network_degree(df).collect()} == want
    close = {(r.month, r.permno): r.network_degree for r in network.network_degree(df, approximate=10).collect()}
    assert set(close) == set(want) and max(abs(close[k] - d) / max(d, 10) for k, d in want.items()) < 0.15
    plan = network.network_degree(df)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap" not in plan


def test_no_positions(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert network.top_edges(none).collect() == network.network_degree(none).collect() == []
