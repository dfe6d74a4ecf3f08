"""The interval index against a scan of all intervals, day by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from holdlens.functions.intervals import interval_index
from holdlens.operators.ownership import clean_names, map_point_in_time

DAY0 = dt.date(2001, 1, 1)


def day(n):
    return None if n is None else DAY0 + dt.timedelta(n)


def check(spark, rows, days):
    df = spark.createDataFrame([(k, day(a), day(b), p, i) for i, (k, a, b, p) in enumerate(rows)], "k string, a date, b date, p int, i int")
    got = interval_index(df, "k", "a", "b", [-F.col("p")]).collect()
    want = {}
    for k in {r[0] for r in rows if r[0]}:
        for d in days:
            held = [(-p, i) for i, (k2, a, b, p) in enumerate(rows) if k2 == k and a is not None and b is not None and a <= d <= b]
            if held:
                want[k, day(d)] = min(held)[1]
    found = {}
    for r in got:
        for d in days:
            if r.piece_start <= day(d) <= r.piece_end:
                assert (r.k, day(d)) not in found
                found[r.k, day(d)] = r.i
    assert found == want
    return got


@pytest.mark.parametrize("rows", [
    [("x", 0, 9, 1), ("x", 3, 5, 2), ("x", 4, 4, 3)], [("x", 0, 9, 3), ("x", 3, 5, 2)], [("x", 2, 4, 1)] * 3, [("x", 0, 2, 1), ("x", 3, 5, 1), ("x", 5, 7, 1), ("y", 1, 1, 1)],
    [("x", 5, 4, 9), (None, 0, 3, 1), ("x", None, 3, 1), ("x", 2, None, 1), ("x", 1, 2, 1)], [],
])
def test_nested_equal_touching_and_broken_intervals(spark, rows):
    check(spark, rows, range(-1, 12))


def test_many_intervals_of_one_key(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", a := rng.randrange(120), a + rng.randrange(40), rng.randrange(6)) for i in range(150)]
    got = check(spark, rows, range(165))
    # pieces are at most twice the intervals of a key
    assert sum(r.k == "hot" for r in got) <= 2 * sum(r[0] == "hot" for r in rows)


def test_open_names_and_no_ranking_of_holdings(spark):
    raw = [("AAAAAA11", 1, None, None, 31), ("AAAAAA11", 2, "2000-01-01", "2000-12-31", 10), ("AAAAAA11", 3, "2000-06-01", None, 11), ("BBBBBB11", 4, None, None, 31), ("CCCCCC11", 6, None, None, 10), ("CCCCCC11", 5, None, None, 10)]
    names = clean_names(spark.createDataFrame([(c, p, p, a, b, s, 1, "T", "N") for c, p, a, b, s in raw], "ncusip string, permno int, permco int, namedt string, nameendt string, shrcd int, exchcd int, ticker string, comnam string"))
    held = [("AAAAAA11", d) for d in ("1999-12-31", "2000-01-01", "2000-05-31", "2000-06-01", "2000-12-31", "2098-01-01")] + [("BBBBBB11", "2000-01-01"), ("CCCCCC11", "2000-01-01"), ("DDDDDD11", "2000-01-01")]
    holdings = spark.createDataFrame([(c, dt.date.fromisoformat(d), d) for c, d in held], "cusip8 string, mapping_date date, d string")
    mapped = map_point_in_time(holdings, names)
    assert {(r.cusip8, r.d, r.permno) for r in mapped.collect()} == {("AAAAAA11", "2000-01-01", 2), ("AAAAAA11", "2000-05-31", 2), ("AAAAAA11", "2000-06-01", 3), ("AAAAAA11", "2000-12-31", 3), ("AAAAAA11", "2098-01-01", 3), ("CCCCCC11", "2000-01-01", 5)}
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "mapping_date" not in "".join(line for line in plan.splitlines() if "Window" in line or "Exchange hash" in line and "mapping_date" in line)
