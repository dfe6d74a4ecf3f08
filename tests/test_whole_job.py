"""The registered model queries run over the operators' whole job."""

from holdlens.operators import econometrics, models
from holdlens.plans import queries


def test_trees_take_all_splits_sets_and_the_default_rounds(spark, monkeypatch):
    asked = []
    splits = spark.createDataFrame([(y,) for y in (1999, 2000, 2001, 2002)], "test_year int")
    b = queries.Build(spark, "")
    b.features_z, b.splits_of = None, lambda target: splits
    monkeypatch.setattr(models, "boosted_models", lambda *a, **k: asked.append((a, k)) or [])
    assert len({(m, t) for m, t, *_ in b.trees}) == len(asked) == 6
    for (_, given, *_), options in asked:
        assert options == {} and {r.test_year for r in given.collect()} == {1999, 2000, 2001, 2002}


def test_fmb_multivariate_runs_the_whole_grid_and_both_targets(spark, monkeypatch):
    asked = []
    out = spark.createDataFrame([], "spec string, target string, month string, variable string, coef double, n_obs long, r2 double, adj_r2 double")
    monkeypatch.setattr(econometrics, "fama_macbeth_grid", lambda df, targets, grid, **k: asked.append((targets, grid)) or out)
    queries._coefficients(queries.build(spark, "/root/testdata/sf0.001"))
    ((targets, grid),) = asked
    assert targets == ["fwd_ret_1m", "fwd_ret_3m"] and len(grid) == 15 and len({tuple(x) for x in grid.values()}) == 15
