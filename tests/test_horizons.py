"""Returns over trading days and up to the end of a listing, against plain loops."""

import datetime as dt
import math
import random

import pytest

from holdlens.operators import horizons

DAILY = "permno long, date date, ret double"
MONTHLY = "permno long, permco long, date date, month_date date, month string, ret double, prc double"
EVENTS = "permno long, date date, dlret double"


def test_days_ahead_equal_a_loop_with_gaps_losses_and_nulls(spark):
    rng = random.Random(11)
    days = [dt.date(2021, 3, 1) + dt.timedelta(days=k) for k in range(0, 90, 2)]
    rows = [(p, d, rng.choice([None, float("nan"), -1.0]) if rng.random() < 0.06 else rng.gauss(0, 0.1)) for p in range(6) for d in days if rng.random() < 0.3 + 0.14 * p]
    made = {(r.permno, r.date): r for r in horizons.daily_forward_returns(spark.createDataFrame([*rows, (None, days[0], 0.5)], DAILY), horizons=(3, 7), least=2).collect()}
    index = {d: k for k, d in enumerate(sorted({d for _, d, _ in rows} | {days[0]}))}
    assert len(made) == len(rows)
    for p, d, _ in rows:
        got = made[p, d]
        assert got.day_index == index[d]
        for h in (3, 7):
            ahead = [r for q, e, r in rows if q == p and index[d] < index[e] <= index[d] + h and r is not None and not math.isnan(r)]
            want = math.prod(1 + r for r in ahead) - 1 if len(ahead) >= 2 and index[d] + h < len(index) else None
            assert got[f"fwd_ret_{h}d"] == (None if want is None else pytest.approx(want, abs=1e-12))
    last = {}
    for p, d, _ in sorted(rows, key=lambda r: r[:2]):
        last[f"{d:%Y-%m}", p] = made[p, d].fwd_ret_3d
    assert {(r.month, r.permno): r.fwd_ret_3d for r in horizons.month_end_horizons(spark.createDataFrame([*made.values()]), horizons=(3,)).collect()} == last


def test_no_rows_and_missing_columns(spark):
    none = spark.createDataFrame([], DAILY)
    assert horizons.daily_forward_returns(none).count() == 0
    assert horizons.forward_to_the_end(horizons.with_delistings(spark.createDataFrame([], MONTHLY), spark.createDataFrame([], EVENTS))).count() == 0
    with pytest.raises(ValueError, match="ret"):
        horizons.daily_forward_returns(none.drop("ret"))


def months(permno, rets):
    return [(permno, permno * 10, dt.date(2020, m, 28), dt.date(2020, m, 1), f"2020-{m:02d}", r, 5.0) for m, r in enumerate(rets, 1)]


def test_listings_end_inside_each_leg(spark):
    rets = [0.1, 0.2, -0.1, 0.05, 0.3]
    rows = [r for p in range(1, 8) for r in months(p, rets)] + months(8, [0.1, None])
    events = [
        (1, dt.date(2020, 5, 30), -0.5),  # in the last month
        (2, dt.date(2020, 7, 2), -0.4),  # after it
        (3, dt.date(2020, 2, 3), -0.9),  # before it: ignored
        (4, dt.date(2020, 6, 1), None),  # unknown
        (5, dt.date(2020, 5, 1), -0.2), (5, dt.date(2020, 5, 9), -0.7), (5, dt.date(2020, 5, 9), -0.1),  # the latest, then the lowest
        (8, dt.date(2020, 2, 28), -0.6), (9, dt.date(2020, 5, 1), -0.3), (None, dt.date(2020, 5, 1), -0.3), (6, None, -0.3),
    ]
    table, given = spark.createDataFrame(rows, MONTHLY), spark.createDataFrame(events, EVENTS)
    for missing, unknown in ((-0.3, -0.3), (None, None)):
        made = horizons.forward_to_the_end(horizons.with_delistings(table, given, missing=missing)).orderBy("permno", "date").collect()
        ended = {1: rets[:4] + [1.3 * 0.5 - 1], 2: [*rets, -0.4], 4: [*rets, unknown], 5: rets[:4] + [1.3 * 0.3 - 1], 8: [0.1, -0.6]}
        for p in range(1, 9):
            mine, series = [r for r in made if r.permno == p], ended.get(p, rets)
            assert len(mine) == len(series)
            assert [r.delisted for r in mine] == [False] * (len(series) - 1) + [p in ended]
            for k, r in enumerate(mine):
                legs = series[k + 1 : k + 4]
                whole = len(legs) == 3 or (p in ended and legs)
                want = math.prod(1 + x for x in legs) - 1 if whole and None not in legs else None
                assert r.ret == (None if series[k] is None else pytest.approx(series[k]))
                assert r.fwd_ret_1m == (None if not legs or legs[0] is None else pytest.approx(legs[0]))
                assert r.fwd_ret_3m == (None if want is None else pytest.approx(want))
        extra = next(r for r in made if r.permno == 2 and r.delisted)
        assert (extra.month, extra.permco, extra.prc, extra.date) == ("2020-07", 20, None, dt.date(2020, 7, 2))
