"""All positions with prices: rounded step by step, in methods that the JVM compiles, and not written before."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from holdlens.operators import ownership
from holdlens.plans import queries
from holdlens.plans.oracle import r
from tests.test_books import _monthly, _snap

#: Bytes of a method beyond which the JVM interprets it.
HUGE = 8000


@pytest.fixture
def made(spark, monkeypatch):
    b = queries.Build(spark, "")
    b.expanded, b.monthly = ownership.expand_filings(_snap(spark), "2021-12-31"), spark.createDataFrame(_monthly(spark).collect(), _monthly(spark).schema)
    monkeypatch.setattr(queries, "build", lambda *a: b)
    return b, queries.QUERIES["position_weights"](spark, "")


def test_positions_are_those_of_books(made):
    b, got = made
    assert "books" not in vars(b) and "trades" not in vars(b)
    want = ownership.with_prices(ownership.books(b.expanded, b.monthly), b.monthly)
    want = want.select(*(queries.rounded(F.col(c).cast("double")).alias(c) if t == "double" else c for c, t in got.dtypes))
    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert rows(got) == rows(want) and got.count() == 47


def test_methods_over_positions_are_compiled(spark, made):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = spark._jvm.PythonSQLUtils.explainString(made[1]._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [(int(size), plan) for size, plan in re.findall(r"maxMethodCodeSize:(\d+).*?==\n(.*?)\n\n?Generated", said, re.S)]
    over = [size for size, plan in sizes if "position_value_proxy" in plan]
    assert over and max(over) < HUGE


def test_rounding_is_that_of_sql(spark):
    values = [s * x for s in (1.0, -1.0) for k in range(-8, 9) for x in (10.0**k, 1.5 * 10.0**k, 2.0 ** (3 * k), 1234567.0 / 2.0 ** (k + 8), 330736907.96362996 * 10.0 ** min(k, 0))]
    values += [0.0, -0.0, -1e-9, 999.9999999, 1e9, 3.3073690796362996e8, -4.3998969238637e8, None]
    df = spark.createDataFrame([(v,) for v in values], "c double").repartition(1)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (c DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [[v] for v in values])
    got = [x.c for x in df.select(queries.rounded(F.col("c")).alias("c")).collect()]
    want = [x for (x,) in con.execute(f"SELECT {r('c')} FROM t").fetchall()]
    key = lambda v: (v is None, v or 0.0)
    assert sorted(got, key=key) == sorted(want, key=key) and "-0.0" not in map(str, got)
