"""All specifications in one pass against separate fits, and rank correlations with nulls against pandas."""

import random

import numpy as np
import pandas as pd
import pytest

from holdlens.operators import econometrics as eco
from holdlens.operators import signals

GRID = {"one": ["a"], "two": ["a", "b"], "all": ["a", "b", "c", "d"], "twins": ["a", "a2"], "never": ["a", "gone"]}


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        a, b, c, d = (rng.gauss(0, 1) for _ in range(4))
        y = 1 + 2 * a - b + 0.5 * c * (i % 3) + rng.gauss(0, 0.1)
        hole = lambda x, k: None if rng.random() < k else x
        rows.append((f"2001-{i % 6 + 1:02d}", i, hole(a, 0.1), hole(b, 0.3), c, hole(d, 0.05), 2 * a, None, hole(y, 0.1), hole(y * y, 0.4)))
    path = str(tmp_path_factory.mktemp("frame") / "t")
    spark.createDataFrame(rows, "month string, permno long, a double, b double, c double, d double, a2 double, gone double, y double, z double").write.parquet(path)
    return spark.read.parquet(path)


def test_one_pass_equals_separate_fits(frame):
    got = eco.fama_macbeth_grid(frame, ["y", "z"], GRID, least=20, per_regressor=4)
    found = {(r.spec, r.target, r.month, r.variable): (r.coef, r.n_obs, r.r2, r.adj_r2) for r in got.collect()}
    want = {}
    for target in ("y", "z"):
        for spec, xs in GRID.items():
            for r in eco.fama_macbeth(frame, target, xs, least=20, per_regressor=4).collect():
                want[spec, target, r.month, r.variable] = (r.coef, r.n_obs, r.r2, r.adj_r2)
    assert set(found) == set(want) and len(want) > 100 and not any(k[0] == "never" for k in want)
    for k, v in want.items():
        assert found[k] == pytest.approx(v, rel=1e-8, abs=1e-9)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_against_least_squares(frame):
    data = frame.select("month", "y", "a", "b").na.drop().toPandas()
    got = {(r.month, r.variable): r.coef for r in eco.fama_macbeth_grid(frame, ["y"], {"two": ["a", "b"]}, least=20, per_regressor=4).collect()}
    for m, g in data.groupby("month"):
        beta = np.linalg.lstsq(np.column_stack((np.ones(len(g)), g[["a", "b"]])), g.y, rcond=None)[0]
        assert [got[m, v] for v in ("const", "a", "b")] == pytest.approx(list(beta), rel=1e-8)


def test_too_many_columns(frame):
    with pytest.raises(ValueError):
        eco.fama_macbeth_grid(frame, ["y"], {"x": [f"x{i}" for i in range(63)]})


@pytest.mark.parametrize("part_rows", [1 << 18, 50])
def test_rank_correlations_with_nulls_and_ties(spark, monkeypatch, part_rows):
    monkeypatch.setattr(signals, "PART_ROWS", part_rows)
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), rng.randrange(5), rng.randrange(40) if rng.random() < 0.7 else None, rng.random() if rng.random() < 0.4 else None, 1.0, None) for _ in range(500)]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], "p double, q double, r double, s double, same double, none double")
    got = {(r.feature_x, r.feature_y): (r.n_obs, r.spearman) for r in signals.spearman_matrix(df, df.columns).collect()}
    data = pd.DataFrame(rows, columns=df.columns, dtype=float)
    for i, x in enumerate(df.columns):
        for y in df.columns[i + 1 :]:
            both = data[[x, y]].dropna()
            if not len(both):
                assert (x, y) not in got
                continue
            rx, ry = both[x].rank(), both[y].rank()
            rho = None if rx.std() == 0 or ry.std() == 0 else np.corrcoef(rx, ry)[0, 1]
            assert got[x, y][0] == len(both) and (got[x, y][1] is None if rho is None else got[x, y][1] == pytest.approx(rho, abs=1e-10))
