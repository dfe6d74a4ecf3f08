"""Cross-sectional regressions by month and time-series regressions with HAC errors.

Only sums of products leave the data rows; the k-by-k systems are solved per group on those sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import require_columns
from holdlens.functions.stats import gram, newey_west


def _square(upper: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return out + np.triu(out, 1).T


def _least_norm(sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """The solution of ``sxx b = sxy``, of least norm if there are several; rank is told on columns of equal size."""
    scale = np.sqrt(np.maximum(np.diag(sxx), 1e-300))
    values, vectors = np.linalg.eigh(sxx / np.outer(scale, scale))
    full = values > 1e-12 * max(values[-1], 1e-300)
    beta = vectors[:, full] @ ((vectors[:, full].T @ (sxy / scale)) / values[full]) / scale
    if full.all():
        return beta
    free = np.linalg.qr(vectors[:, ~full] / scale[:, None])[0]
    return beta - free @ (free.T @ beta)


def spec_grid(direct: list[str], network: list[str], mechanism: list[str], controls: list[str], crossed: list[str]) -> dict[str, list[str]]:
    """Regressors of each specification: every signal alone, three families, all signals without and with controls, and products."""
    grid = {f"univariate__{s}": [s] for s in [*direct, *network]}
    families = {"direct_ownership_core": direct, "network_core": network, "sell_pressure_mechanism": mechanism}
    grid |= {name: [*xs, *controls] for name, xs in families.items() if xs}
    grid |= {"full_core_no_controls": [*direct, *network], "full_core_with_controls": [*direct, *network, *controls]}
    if crossed:
        grid["interaction_mechanism"] = [*mechanism, *crossed, *controls]
    return grid


def fama_macbeth(df: DataFrame, target: str, xs: list[str], *, by: str = "month", least: int = 50, per_regressor: int = 10) -> DataFrame:
    """``(month, variable, coef, n_obs, r2, adj_r2)``: an OLS with constant for each month with enough complete rows.

    Enough: max(least, per_regressor * number of coefficients). Collinear regressors get the solution of least norm.
    """
    require_columns(df, [by, target, *xs])
    k = len(xs) + 1
    sums = gram(df, [by], target, xs).where(F.col("n") >= max(least, per_regressor * k))
    names = ["const", *xs]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                sxx, sxy, n = _square(np.array(r.sxx), k), np.array(r.sxy), int(r.n)
                beta = _least_norm(sxx, sxy)
                rss = max(r.syy - 2 * beta @ sxy + beta @ sxx @ beta, 0.0)
                tss = r.syy - sxy[0] ** 2 / n
                r2 = 1 - rss / tss if tss > 0 else None
                adj = 1 - (1 - r2) * (n - 1) / max(n - k, 1) if r2 is not None else None
                out += [(getattr(r, by), v, float(b), n, r2, adj) for v, b in zip(names, beta, strict=True)]
            yield pd.DataFrame(out, columns=[by, "variable", "coef", "n_obs", "r2", "adj_r2"])

    return sums.mapInPandas(solve, f"{by} string, variable string, coef double, n_obs long, r2 double, adj_r2 double")


def _masked_sums(df: DataFrame, by: str, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Sums of the products ``pairs`` of each ``by`` and pattern of present columns (bit i of ``mask``: column i isn't null), in one pass.

    A product with a null counts as nothing; it belongs to a pattern that lacks the column, which no one asks for its sum.
    """
    present = sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0).cast("long"))
    of = lambda c: F.lit(1.0) if c == "const" else F.col(c).cast("double")
    return df.groupBy(by, present.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(of(x) * of(y)), F.lit(0.0)).alias(f"s{i}") for i, (x, y) in enumerate(pairs)))


def fama_macbeth_grid(df: DataFrame, targets: list[str], grid: dict[str, list[str]], *, by: str = "month", least: int = 50, per_regressor: int = 10) -> DataFrame:
    """``fama_macbeth`` of each target and specification of ``grid``, with columns ``spec`` and ``target``, from one pass over ``df``.

    Rows are summed by their pattern of present columns. A specification's complete rows are the patterns that hold all its columns, so its sums are
    those patterns' sums; patterns are few, and only their sums are read once for each specification. At most 63 columns.
    """
    columns = list(dict.fromkeys([*(x for xs in grid.values() for x in xs), *targets]))
    if len(columns) > 63:
        raise ValueError(f"{len(columns)} columns, at most 63")
    require_columns(df, [by, *columns])
    place: dict[tuple[str, str], int] = {}
    runs = []
    for target in targets:
        for spec, xs in grid.items():
            names = ["const", *xs]
            wanted = [(x, y) for i, x in enumerate(names) for y in names[i:]] + [(x, target) for x in names] + [(target, target)]
            at = [place.setdefault(p if p in place or p[::-1] not in place else p[::-1], len(place)) for p in wanted]
            need = sum(1 << columns.index(c) for c in [*xs, target])
            runs.append((spec, target, names, need, at))
    sums = _masked_sums(df, by, columns, list(place))
    asked = df.sparkSession.createDataFrame([(i, r[3]) for i, r in enumerate(runs)], "run int, need long")
    # a row for each pattern and the specifications that it serves; the products are the same columns for all
    served = sums.join(F.broadcast(asked), F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))
    whole = served.groupBy(by, "run").agg(F.sum("n").alias("n"), F.array(*(F.sum(f"s{i}") for i in range(len(place)))).alias("sums"))

    def solve(batches):
        for pdf in batches:
            out = []
            for month, run, n, sums in zip(pdf[by], pdf["run"], pdf["n"], pdf["sums"], strict=True):
                spec, target, names, _, at = runs[run]
                k, x = len(names), np.asarray(sums)[at]
                if n < max(least, per_regressor * k):
                    continue
                sxx, sxy, syy = _square(x[: k * (k + 1) // 2], k), x[k * (k + 1) // 2 : -1], x[-1]
                beta = _least_norm(sxx, sxy)
                rss, tss = max(syy - 2 * beta @ sxy + beta @ sxx @ beta, 0.0), syy - sxy[0] ** 2 / n
                r2 = 1 - rss / tss if tss > 0 else None
                adj = 1 - (1 - r2) * (n - 1) / max(n - k, 1) if r2 is not None else None
                out += [(spec, target, month, v, float(b), int(n), r2, adj) for v, b in zip(names, beta, strict=True)]
            yield pd.DataFrame(out, columns=["spec", "target", by, "variable", "coef", "n_obs", "r2", "adj_r2"])

    return whole.mapInPandas(solve, f"spec string, target string, {by} string, variable string, coef double, n_obs long, r2 double, adj_r2 double")


def fama_macbeth_univariate(long: DataFrame, *, least: int = 50, per_regressor: int = 10) -> DataFrame:
    """The one-regressor case for all of ``long(month, feature, target, x, y)`` at once, in aggregates only."""
    out = long.groupBy("feature", "target", "month").agg(F.count(F.lit(1)).alias("n_obs"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    out = out.where(F.col("n_obs") >= max(least, 2 * per_regressor)).where("slope is not null")
    return out.withColumn("adj_r2", 1 - (1 - F.col("r2")) * (F.col("n_obs") - 1) / F.greatest(F.col("n_obs") - 2, F.lit(1)))


def fmb_summary(coefs: DataFrame, by: list[str], *, value: str = "coef", max_lag: int = 6) -> DataFrame:
    """Newey-West mean, se and t of the monthly coefficients, their sd and the share of positive months."""
    nw = newey_west(coefs, by, "month", value, max_lag, also={"positive_month_share": F.avg((F.col(value) > 0).cast("int"))})
    return nw.select(*by, F.col("n").alias("months"), F.col("mean").alias("mean_coef"), F.col("se").alias("nw_se"), F.col("t").alias("nw_t"), F.col("std").alias("coef_std"), "positive_month_share")


def strongest(summary: DataFrame, *, target: str, controls: list[str], t: str = "nw_t", n: int = 10) -> DataFrame:
    """The ``n`` signals of greatest absolute t for a target: neither constants nor ``controls``; ties by name."""
    signals = summary.where((F.col("target") == target) & ~F.col("variable").isin("const", *controls) & F.col(t).isNotNull())
    return signals.withColumn("abs_t", F.abs(t)).orderBy(F.col("abs_t").desc(), "spec", "variable").limit(n)


def fmb_model_summary(coefs: DataFrame, by: list[str]) -> DataFrame:
    """Months, sizes and adjusted R2 of each specification."""
    months = coefs.select(*by, "month", "n_obs", "adj_r2").distinct()
    return months.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), F.avg("n_obs").alias("mean_n"), F.min("n_obs").alias("min_n"), F.avg("adj_r2").alias("mean_adj_r2"), F.median("adj_r2").alias("median_adj_r2"))


def hac_regression(df: DataFrame, by: list[str], order: str, y: str, xs: list[str], *, lags: int = 6, least: int = 36) -> DataFrame:
    """OLS of ``y`` on ``xs`` and a constant in each group with HAC covariance (Bartlett, ``lags``), on complete rows.

    ``(by, n, r2, variable, coef, t)``. A first pass sums products for the coefficients; a second sums products of the scores
    u = x * residual with their own lags, found by ``lag``. The last step works on these sums, a row for each group.
    """
    k = len(xs) + 1
    full = df.na.drop(subset=[y, *xs]).withColumn("const", F.lit(1.0))
    sums = gram(full, by, y, xs).where(F.col("n") >= least)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def coefficients(batches):
        for pdf in batches:
            beta = [np.linalg.lstsq(_square(np.array(a), k), np.array(b), rcond=None)[0].tolist() for a, b in zip(pdf["sxx"], pdf["sxy"], strict=True)]
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "beta": beta})

    beta = sums.mapInPandas(coefficients, f"{kinds}, beta array<double>")
    names = ["const", *xs]
    fitted = sum((F.col("beta")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    scored = full.join(beta, by).withColumn("e", F.col(y) - fitted)
    scored = scored.select(*by, order, *((F.col(n) * F.col("e")).alias(f"u{i}") for i, n in enumerate(names)))
    w = Window.partitionBy(*by).orderBy(order)
    lagged = scored.select("*", *(F.lag(f"u{i}", m).over(w).alias(f"u{i}_{m}") for i in range(k) for m in range(1, lags + 1)))
    meat = [F.sum(F.col(f"u{i}") * F.col(f"u{j}" if m == 0 else f"u{j}_{m}")) for m in range(lags + 1) for i in range(k) for j in range(k)]
    gammas = lagged.groupBy(*by).agg(F.array(*(F.coalesce(x, F.lit(0.0)) for x in meat)).alias("gammas"))
    ready = sums.join(beta, by).join(gammas, by)

    def finish(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                bread, n = np.linalg.pinv(_square(np.array(r["sxx"]), k)), int(r["n"])
                g = np.array(r["gammas"]).reshape(lags + 1, k, k)
                s = g[0] + sum((1 - m / (lags + 1)) * (g[m] + g[m].T) for m in range(1, lags + 1))
                b = np.array(r["beta"])
                se = np.sqrt(np.maximum(np.diag(bread @ s @ bread), 0))
                sxy = np.array(r["sxy"])
                tss = r["syy"] - sxy[0] ** 2 / n
                r2 = 1 - max(r["syy"] - b @ sxy, 0.0) / tss if tss > 0 else None
                out += [(*(r[c] for c in by), n, r2, v, float(b[i]), float(b[i] / se[i]) if se[i] > 0 else None) for i, v in enumerate(names)]
            yield pd.DataFrame(out, columns=[*by, "n", "r2", "variable", "coef", "t"])

    return ready.mapInPandas(finish, f"{kinds}, n long, r2 double, variable string, coef double, t double")
