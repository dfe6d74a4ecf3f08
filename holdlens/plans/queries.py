"""The registered queries over the sample mapping, each beside its SQL.

Columns are named and typed once for both: s string, i long, n int, d rounded double, e double that its source has rounded, D date, b boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdlens.functions import stats
from holdlens.operators import econometrics as eco
from holdlens.operators import downside, horizons, models, network, ownership, portfolio, quality, robustness, signals
from holdlens.plans.oracle import ann as annualizing
from holdlens.plans.oracle import FEATURES, direction, hac, metrics, newey_west, ols, r, strata, with_ctes
from holdlens.sources import sample, scans
from holdlens.sources.shared import small, written

#: The sample has 83 months and about a hundred stocks, so gates are lower than the operators' own.
IC_ROWS, METRIC_ROWS, VALID, MIN_TRAIN, LEAST_ROWS = 50, 30, 12, 24, (1000, 100, 100)
DIRECT = ["owner_count", "owner_hhi", "top_owner_share", "fragility_proxy", "avg_manager_breadth", "stock_sell_pressure"]
NETWORK = ["network_degree", "network_weighted_degree", "network_peer_sell_pressure"]
MECHANISM = ["fragility_proxy", "stock_sell_pressure", "network_peer_sell_pressure"]
PAIRS = [("fragility_proxy", "stock_sell_pressure"), ("fragility_proxy", "network_peer_sell_pressure"), ("owner_hhi", "stock_sell_pressure"), ("network_weighted_degree", "network_peer_sell_pressure")]
MINIMUMS = {"clean_holdings_rows": 100, "common_mapping_rate": 0.5, "panel_months": 24, "fwd_ret_1m_coverage": 0.5, "median_owner_count": 1, "panel_rows": 10_000_000}


def rounded(c: Column) -> Column:
    """6 decimals, fewer where it is large, 9 digits from 1e9 on, and no negative zero.

    A small shift keeps values that lie between two results from falling either way.
    """
    size = F.abs(c)
    # as F.round does, half away from 0, without its decimal numbers: a long table has many values
    to = lambda x, unit: F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit
    large = F.when(size >= 1e9, F.format_string("%.8e", c).cast("double")).when(size >= 1e6, to(c + 0.00137, 1e2))
    return large.when(size >= 1000, to(c + 0.0000137, 1e4)).otherwise(to(c + 0.00000000137, 1e6) + 0.0)


class Build:
    """The steps from raw tables to the panel, each made once and lazily.

    What several steps read is written to the shared folder, so that plans stay short and executors may be lost.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def trades(self):
        return written(sample.trades(self.spark, self.sf_dir), "trades")

    @cached_property
    def holdings(self):
        return ownership.clean_holdings(sample.raw_holdings(self.trades), sample.START, sample.END)

    @cached_property
    def names(self):
        return ownership.clean_names(sample.raw_names(self.spark, self.sf_dir))

    @cached_property
    def monthly(self):
        """Written, so that its size is known: positions meet it by a broadcast where it is small."""
        return written(ownership.forward_returns(ownership.clean_monthly(sample.raw_monthly(self.trades))), "monthly")

    @cached_property
    def to_the_end(self):
        """Monthly rows with terminal returns, and forward returns up to them."""
        rows = ownership.clean_monthly(sample.raw_monthly(self.trades))
        return written(horizons.forward_to_the_end(horizons.with_delistings(rows, sample.raw_delistings(self.trades), missing=-0.3)), "delisted")

    @cached_property
    def daily(self):
        return written(horizons.daily_forward_returns(sample.raw_daily(self.trades)), "daily")

    @cached_property
    def horizon_long(self):
        """Features at each month's end against returns over the trading days that follow."""
        ahead = horizons.month_end_horizons(self.daily)
        targets = {f"fwd_ret_{h}d": F.round(f"fwd_ret_{h}d", 8) for h in horizons.HORIZONS}
        return written(signals.to_long(self.panel.join(ahead.withColumns(targets), ["month", "permno"]), FEATURES, [*targets]), "horizons")

    @cached_property
    def mapped(self):
        return ownership.map_point_in_time(self.holdings, self.names)

    @cached_property
    def snap(self):
        return ownership.snapshot(self.mapped)

    @cached_property
    def windows(self):
        return ownership.filing_windows(self.snap, sample.END)

    @cached_property
    def expanded(self):
        return ownership.expand_filings(self.snap, sample.END)

    @cached_property
    def numbers(self):
        return small(written(ownership.stock_numbers(self.names), "numbers"))

    @cached_property
    def folios(self):
        """A row for each month of a manager, after one shuffle by manager; what the panel needs of positions."""
        return written(ownership.folios(self.snap, small(self.monthly), self.numbers, sample.END), "folios")

    def phi_top_edges(self, top_k: int) -> DataFrame:
        """By squares of a month's weights where its stocks have words; the books' rows are read once, so they aren't written."""
        if self.numbers.count() > 64 * ownership.FOLIO_WORDS:
            return network.top_edges(network.with_phi(self.weights), top_k=top_k, phi=F.col("phi"))
        return network.folio_top_edges(ownership.folios(self.snap, small(self.monthly), self.numbers, sample.END), self.numbers, top_k=top_k, lagged=True, rows=self.trades.count())

    @cached_property
    def books(self):
        """All of a manager's rows from raw holdings on, after one shuffle by manager."""
        return written(ownership.books(self.expanded, small(self.monthly)), "books")

    @cached_property
    def positions(self):
        return ownership.with_prices(self.books, small(self.monthly))

    @cached_property
    def priced(self):
        """Positions for a query that returns them all: not written, and rounded step by step.

        Prices are rounded in their own table, a position's own numbers before its manager's month is summed up. So they are few at the end: the JVM leaves
        a method of many to its interpreter.
        """
        own = ["shares", "reported_value", "filing_lag_days"]
        of = lambda names: {c: rounded(F.col(c).cast("double")) for c in names}
        prices = self.monthly.withColumns(of(ownership.PRICES))
        valued = ownership.valued(self.expanded, small(self.monthly)).withColumns(of(own) | {"returned": rounded(F.col("position_value_proxy"))})
        made = ownership.with_prices(ownership.weighed(valued), small(prices))
        return made.drop("position_value_proxy").withColumnRenamed("returned", "position_value_proxy")

    @cached_property
    def weights(self):
        return ownership.weights(self.books)

    @cached_property
    def enriched(self):
        return ownership.sell_pressure(self.positions)

    @cached_property
    def stock(self):
        return written(ownership.stock_features(ownership.held_rows(self.folios, self.numbers), self.monthly), "stock")

    @cached_property
    def degree(self):
        few = self.numbers.count() <= 64 * ownership.FOLIO_WORDS
        return network.folio_degree(self.folios, self.numbers) if few else network.network_degree(self.weights)

    @cached_property
    def weighted(self):
        return network.folio_weighted(self.folios, self.numbers, self.stock)

    @cached_property
    def full_panel(self):
        return written(network.attach_network(self.stock, self.degree, self.weighted), "panel")

    @cached_property
    def panel(self):
        """Features and targets to 8 decimals, so that equal values tie whatever the order of their sums."""
        return self.full_panel.withColumns({c: F.round(c, 8) for c in [*FEATURES, *signals.TARGETS] if c not in ("owner_count", "network_degree")})

    @cached_property
    def long(self):
        return written(signals.to_long(self.panel, FEATURES, signals.TARGETS), "pairs")

    @cached_property
    def deciles(self):
        return written(signals.decile_monthly(self.long), "deciles")

    @cached_property
    def ic(self):
        return signals.rank_ic_monthly(self.long, least=IC_ROWS)

    @cached_property
    def predictions(self):
        out = None
        for name, c in (("all", "owner_hhi"), ("no_network", "fragility_proxy")):
            for t in signals.TARGETS:
                part = self.panel.where(F.col(t).isNotNull()).select(F.lit(name).alias("model"), F.lit(t).alias("target"), "month", "permno", (-F.col(c)).alias("prediction"), F.col(t).alias("actual_return"))
                out = part if out is None else out.unionByName(part)
        return written(out, "predictions")

    @cached_property
    def book(self):
        return written(portfolio.decile_holdings(self.predictions), "book")

    @cached_property
    def folio(self):
        return written(portfolio.portfolio_of(self.book), "folio")

    @cached_property
    def performance(self):
        return written(portfolio.performance_summary(self.folio), "performance")

    @cached_property
    def factors(self):
        """Market: mean return; smb and hml: spreads of market-value and price thirds."""
        m = self.monthly.where("ret is not null").select("month", "permno", "ret", "mktcap_proxy", "prc", "date")
        third = {c: stats.rank_share(["month"], c) for c in ("mktcap_proxy", "prc")}
        m = m.withColumns({"size": third["mktcap_proxy"], "price": third["prc"]})
        of = lambda c: F.avg(F.when(c, F.col("ret")))
        raw = m.groupBy(F.last_day("date").alias("date")).agg(F.avg("ret").alias("mkt_rf"), (of(F.col("size") <= 1 / 3) - of(F.col("size") > 2 / 3)).alias("smb"), (of(F.col("price") > 2 / 3) - of(F.col("price") <= 1 / 3)).alias("hml"))
        stored = written(raw.select(F.to_timestamp("date").alias("DATEFF"), F.col("mkt_rf").alias("mkt-rf"), F.col("smb").alias("SMB"), "hml", F.lit("monthly").alias("kind")), "factors")
        return portfolio.prepare_factors(scans.factor_scan(stored, sample.START, sample.END), "1995-01", "2002-12")

    @cached_property
    def winsorized_z(self):
        z = stats.zscore(stats.winsorize(self.panel, ["month"], [*FEATURES, *signals.TARGETS], min_n=50), ["month"], FEATURES)
        return written(stats.products(z, [(f"z_{x}", f"z_{y}") for x, y in PAIRS]), "winsorized")

    @cached_property
    def features_z(self):
        z = stats.robust_zscore(self.panel, ["month"], FEATURES)
        return written(stats.products(z, [(f"rz_{a}", f"rz_{b}") for a, b in PAIRS], 8.0), "features")

    @cached_property
    def model_features(self):
        return [*(f"rz_{f}" for f in FEATURES), *(f"rz_{a}_x_rz_{b}" for a, b in PAIRS)]

    @cached_property
    def splits(self):
        """The splits of both targets."""
        return written(reduce(DataFrame.unionByName, (models.expanding_splits(self.panel, t, valid=VALID, min_train=MIN_TRAIN) for t in signals.TARGETS)), "splits")

    def splits_of(self, target: str) -> DataFrame:
        return models.enough_rows(self.panel, self.splits.where(F.col("target") == target), target, LEAST_ROWS)

    def _oos(self, fit: Callable, name: str, sets: list[str]) -> DataFrame:
        """Out-of-sample predictions of ``fit`` for both targets and the named feature sets."""
        found = models.feature_sets(self.model_features)
        splits = {t: written(self.splits_of(t), "splits") for t in signals.TARGETS}
        return written(reduce(DataFrame.unionByName, (fit(self.features_z, splits[t], t, found[x], model=f"{name}_{x}") for t in signals.TARGETS for x in sets)), name)

    @cached_property
    def ridge(self):
        return self._oos(models.ridge_oos, "ridge", ["all", "no_network", "network_pressure"])

    @cached_property
    def trees(self):
        """(model, target, features, splits, fits) of boosted trees for both targets and all feature sets."""
        found = models.feature_sets(self.model_features)
        splits = {t: written(self.splits_of(t), "splits") for t in signals.TARGETS}
        return [(f"boosted_{x}", t, xs, splits[t], models.boosted_models(self.features_z, splits[t], t, xs)) for t in signals.TARGETS for x, xs in found.items()]

    @cached_property
    def boosted(self):
        return written(reduce(DataFrame.unionByName, (models.boosted_predict(fits, self.features_z, splits, t, xs, model=m) for m, t, xs, splits, fits in self.trees)), "boosted")

    @cached_property
    def tree_importance(self):
        return written(reduce(DataFrame.unionByName, (models.tree_importance(fits, self.features_z, splits, t, xs, model=m) for m, t, xs, splits, fits in self.trees)), "importance")

    @cached_property
    def modelled(self):
        """Predictions of ridge and trees."""
        return written(self.ridge.unionByName(self.boosted).where("prediction is not null"), "modelled")

    @cached_property
    def model_folio(self):
        return written(portfolio.build_portfolio(self.modelled), "folio")

    @cached_property
    def model_performance(self):
        return written(portfolio.performance_summary(self.model_folio), "performance")

    @cached_property
    def ridge_performance(self):
        return written(portfolio.performance_summary(portfolio.build_portfolio(self.ridge)), "performance")


_builds: dict[tuple[str, str], tuple[tuple, Build]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Number and hash of the files that the tables are in now, their sizes and times."""
    files = reduce(DataFrame.unionByName, (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{t}.parquet").select("path", "length", "modificationTime") for t in ("lineitem", "part")))
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def build(spark: SparkSession, sf_dir: str) -> Build:
    """One for each application, folder and state of its files, so that queries share what is written; see ``forget``."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    if _builds.get(key, (None,))[0] != state:
        _builds[key] = (state, Build(spark, sf_dir))
    return _builds[key][1]


def forget() -> None:
    """Lets all steps be made again, after tables have changed or to time a query alone."""
    _builds.clear()


_TYPES = {"e": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "i": ("long", "BIGINT"), "n": ("int", "INTEGER"), "D": ("date", "DATE"), "b": ("boolean", "BOOLEAN")}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, columns: str, source: Callable[[Build], DataFrame], sql: str | None = None, extra: dict[str, str] | None = None):
    """``columns``: "name:kind ..."; ``sql``: what follows FROM."""
    spec = [c.split(":") for c in columns.split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(build(spark, sf_dir)).select(*((rounded(F.col(c).cast("double")) if k == "d" else F.col(c).cast(_TYPES[k][0])).alias(c) for c, k in spec))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = with_ctes("SELECT " + ", ".join(r(f'"{c}"', f'"{c}"') if k in "de" else f'"{c}"::{_TYPES[k][1]} AS "{c}"' for c, k in spec) + f" FROM {sql}", extra)


_PRICES = "ret:d retx:d prc:d shrout:d vol:d mktcap_proxy:d fwd_ret_1m:d fwd_ret_3m:d"
_FILING = "manager_id:s permno:i permco:i report_date:D available_date:D report_quarter:s shares:d reported_value:d filing_lag_days:d"
_STOCK = f"month_date:D month:s permno:i permco:i owner_count:i total_position_value_proxy:d owner_hhi:d top_owner_share:d fragility_proxy:d avg_manager_breadth:d stock_sell_pressure:d {_PRICES} year:n"

_register("calendar_windows", "window_start:D window_end:D", lambda b: scans.calendar_windows(b.spark, "1995-01-15", "2002-07-20", 3).join(b.holdings.select(F.col("available_date").alias("d")).distinct(), F.col("d").between(F.col("window_start"), F.col("window_end")), "left_semi"),
          "(SELECT s::DATE AS window_start, least((s + INTERVAL 3 MONTH)::DATE - 1, DATE '2002-07-20') AS window_end FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-07-20', INTERVAL 3 MONTH)) AS s)) w WHERE EXISTS (SELECT 1 FROM holdings WHERE available_date BETWEEN window_start AND window_end)")
_register("clean_holdings", "manager_id:s cusip8:s report_date:D filing_date:D available_date:D mapping_date:D available_month:D report_quarter:s filing_lag_days:n shares:d reported_value:d", lambda b: b.holdings, "holdings")
_register("clean_names", "permno:i cusip8:s permco:i name_start:D name_end:D shrcd:n exchcd:n ticker:s comnam:s is_common_stock:b", lambda b: b.names, "names")
_register("clean_monthly", "permno:i date:D permco:i month_date:D month:s ret:d retx:d prc:d shrout:d vol:d mktcap_proxy:d", lambda b: b.monthly, "monthly")
_register("forward_returns", "permno:i month:s ret:d fwd_ret_1m:d fwd_ret_3m:d", lambda b: b.monthly, "monthly")
_register("map_point_in_time", "manager_id:s cusip8:s report_date:D available_date:D permno:i permco:i shrcd:n exchcd:n ticker:s comnam:s is_common_stock:b shares:d reported_value:d", lambda b: b.mapped, "mapped")
_register("snapshot", f"{_FILING} available_month:D mapping_date:D", lambda b: b.snap, "snap")
_register("filing_windows", "manager_id:s report_date:D available_date:D active_start_month:D active_end_month:D", lambda b: b.windows, "wins")
_register("expand_positions", f"month_date:D month:s {_FILING}", lambda b: b.expanded, "expanded")
_register("position_weights", f"month_date:D month:s {_FILING} {_PRICES} position_value_proxy:d ".replace(":d", ":e") + "manager_total_value_proxy:d portfolio_weight:d year:n", lambda b: b.priced, "positions")
_register("manager_features", "month_date:D month:s manager_id:s manager_breadth:i manager_total_value_proxy:d manager_concentration:d", lambda b: ownership.manager_features(b.weights), "mgr")
_register("sell_pressure", "month:s manager_id:s permno:i manager_breadth:i manager_concentration:d stock_owner_share:d lag_position_value_proxy:d sell_amount_proxy:d", lambda b: b.enriched, "enriched")
_register("stock_features", _STOCK, lambda b: b.stock, "stock")
_register("coverage_by_month", "month:s position_rows:i stocks:i managers:i avg_portfolio_weight:d", lambda b: ownership.coverage_by_month(b.positions), "(SELECT month, count(*) AS position_rows, count(DISTINCT permno) AS stocks, count(DISTINCT manager_id) AS managers, avg(portfolio_weight) AS avg_portfolio_weight FROM positions GROUP BY ALL)")
_register("network_edges", "month:s i:i j:i g:d", lambda b: network.common_ownership_edges(b.weights), "edges")
_register("network_topk_edges", "month:s i:i j:i g:d rank:n", lambda b: network.top_edges(b.weights),
          f"(SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(g, {network.TIE_DECIMALS}) DESC, i, j) AS rank FROM edges WHERE g > 0) WHERE rank <= {network.TOP_EDGES}")
_register("network_degree", "month:s permno:i network_degree:i", lambda b: b.degree, "network")
_register("network_weighted_degree", "month:s permno:i network_weighted_degree:d", lambda b: b.weighted, "network")
_register("network_peer_pressure", "month:s permno:i network_peer_sell_pressure:d", lambda b: b.weighted, "network")
_PHI = {"both_months": "SELECT month_date, manager_id, permno, portfolio_weight AS now, 0.0::DOUBLE AS before FROM positions UNION ALL SELECT (month_date + INTERVAL 1 MONTH)::DATE, manager_id, permno, 0.0::DOUBLE, portfolio_weight FROM positions",
        "weighed": "SELECT month_date, manager_id, sum(abs(now - before)) AS moved, sum(now) AS now, sum(before) AS before, sum(now * now) AS concentration FROM (SELECT month_date, manager_id, permno, sum(now) AS now, sum(before) AS before FROM both_months GROUP BY ALL) GROUP BY ALL",
        "lagged": "SELECT (month_date + INTERVAL 1 MONTH)::DATE AS month_date, manager_id, (1 + CASE WHEN before > 0 THEN moved / 2 ELSE 0 END) * (1 + concentration) AS phi FROM weighed WHERE now > 0",
        "phis": "SELECT m.month_date, m.manager_id, coalesce(l.phi, 1) AS phi FROM (SELECT DISTINCT month_date, manager_id FROM positions) m LEFT JOIN lagged l ON m.month_date = l.month_date AND m.manager_id = l.manager_id",
        "phi_edges": "SELECT a.month, a.permno AS i, b.permno AS j, sum(phi * a.portfolio_weight * b.portfolio_weight) AS g FROM positions a JOIN positions b ON a.month = b.month AND a.manager_id = b.manager_id AND a.permno < b.permno JOIN phis f ON f.month_date = a.month_date AND f.manager_id = a.manager_id GROUP BY ALL",
        "phi_ends": "SELECT month, i AS permno, g FROM phi_edges UNION ALL SELECT month, j, g FROM phi_edges"}
_register("manager_phi", "month_date:D manager_id:s phi:d", lambda b: network.manager_phi(b.weights), "phis", _PHI)
_register("network_phi_topk_edges", "month:s i:i j:i g:d rank:n", lambda b: b.phi_top_edges(500), f"(SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(g, {network.TIE_DECIMALS}) DESC, i, j) AS rank FROM phi_edges) WHERE rank <= 500", _PHI)
_register("network_phi_weighted_degree", "month:s permno:i network_weighted_degree:d", lambda b: network.network_weighted(network.with_phi(b.weights), small(b.stock), phi=F.col("phi")), "(SELECT h.month, h.permno, coalesce(sum(g), 0) AS network_weighted_degree FROM held h LEFT JOIN phi_ends e ON h.month = e.month AND h.permno = e.permno GROUP BY ALL)", _PHI)
_register("panel", f"{_STOCK} network_degree:i network_weighted_degree:d network_peer_sell_pressure:d", lambda b: b.full_panel, "panel0")
_register("describe_panel", "rows:i months:i stocks:i min_month:s max_month:s fwd_ret_1m_coverage:d fwd_ret_3m_coverage:d", lambda b: quality.describe_panel(b.panel), '(SELECT count(*) AS "rows", count(DISTINCT month) AS months, count(DISTINCT permno) AS stocks, min(month) AS min_month, max(month) AS max_month, avg((fwd_ret_1m IS NOT NULL)::INTEGER) AS fwd_ret_1m_coverage, avg((fwd_ret_3m IS NOT NULL)::INTEGER) AS fwd_ret_3m_coverage FROM panel)')
_register("feature_coverage", "feature:s is_core_signal:b expected_high_minus_low_sign:s non_null_rows:i coverage:d months_non_null:i mean_value:d median_value:d min_value:d max_value:d", lambda b: quality.feature_coverage(b.panel, FEATURES, set(signals.CORE_FEATURES), signals.NEGATIVE),
          "(" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f in signals.CORE_FEATURES} AS is_core_signal, '{'negative' if f in signals.NEGATIVE else 'not_prespecified'}' AS expected_high_minus_low_sign, count({f}) AS non_null_rows, count({f}) / greatest(count(*), 1) AS coverage, count(DISTINCT month) FILTER ({f} IS NOT NULL) AS months_non_null, avg({f}) AS mean_value, median({f}) AS median_value, min({f}) AS min_value, max({f}) AS max_value FROM panel" for f in FEATURES) + ")")
_register("decile_monthly", "feature:s target:s month:s decile:n n_obs:i mean_return:d median_return:d", lambda b: b.deciles, "deciles")
_register("decile_summary", "feature:s target:s decile:n months:i avg_n_obs:d mean_return:d median_return:d", lambda b: signals.decile_summary(b.deciles), "(SELECT feature, target, decile, count(DISTINCT month) AS months, avg(n_obs) AS avg_n_obs, avg(mean_return) AS mean_return, avg(median_return) AS median_return FROM deciles GROUP BY ALL)")
_register("spread_monthly", "feature:s target:s month:s high_minus_low:d low_minus_high:d", lambda b: signals.spread_monthly(b.deciles), "(SELECT *, -high_minus_low AS low_minus_high FROM spreads)")


def _t(x: str) -> str:
    return f"CASE WHEN count({x}) >= 3 THEN avg({x}) / nullif(stddev_samp({x}) / sqrt(count({x})), 0) END"


_signed = {k: f"SELECT *, {v} * (CASE WHEN feature IN ({', '.join(repr(f) for f in sorted(signals.NEGATIVE))}) THEN -1.0::DOUBLE ELSE 1.0 END) AS d FROM {c} WHERE {v} IS NOT NULL" for k, v, c in (("signed_s", "high_minus_low", "spreads"), ("signed_i", "rank_ic", "ic"))}
_register("spread_summary", "feature:s target:s months:i mean_spread:d annualized_spread:d t_stat:d positive_rate:d directional_mean:d directional_t:d directional_positive_rate:d", lambda b: signals.spread_summary(signals.spread_monthly(b.deciles)),
          f"(SELECT feature, target, count(*) AS months, avg(high_minus_low) AS mean_spread, 12 * avg(high_minus_low) AS annualized_spread, {_t('high_minus_low')} AS t_stat, avg((high_minus_low > 0)::INTEGER) AS positive_rate, avg(d) AS directional_mean, {_t('d')} AS directional_t, avg((d > 0)::INTEGER) AS directional_positive_rate FROM signed_s GROUP BY ALL)", _signed)
_register("rank_ic_monthly", "feature:s target:s month:s n_obs:i rank_ic:d", lambda b: b.ic, "ic")
_register("rank_ic_summary", "feature:s target:s months:i mean_ic:d ic_std:d t_stat:d positive_rate:d directional_mean:d directional_t:d", lambda b: signals.rank_ic_summary(b.ic),
          f"(SELECT feature, target, count(*) AS months, avg(rank_ic) AS mean_ic, stddev_samp(rank_ic) AS ic_std, {_t('rank_ic')} AS t_stat, avg((rank_ic > 0)::INTEGER) AS positive_rate, avg(d) AS directional_mean, {_t('d')} AS directional_t FROM signed_i GROUP BY ALL)", _signed)


_register("spread_summary_by_t", "feature:s target:s directional_t:d place:n", lambda b: signals.ranked_by_t(signals.spread_summary(signals.spread_monthly(b.deciles))),
          f"(SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(directional_t) DESC NULLS LAST, feature) AS place FROM (SELECT feature, target, {_t('d')} AS directional_t FROM signed_s GROUP BY ALL))", _signed)
_register("rank_ic_summary_by_t", "feature:s target:s directional_t:d place:n", lambda b: signals.ranked_by_t(signals.rank_ic_summary(b.ic)),
          f"(SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(directional_t) DESC NULLS LAST, feature) AS place FROM (SELECT feature, target, {_t('d')} AS directional_t FROM signed_i GROUP BY ALL))", _signed)
_register("running_spread", "feature:s target:s month:s cum_directional_spread:d", lambda b: signals.running_spread(signals.spread_monthly(b.deciles)),
          f"(SELECT feature, target, month, sum(coalesce(high_minus_low * {direction}, 0)) OVER (PARTITION BY feature, target ORDER BY month) AS cum_directional_spread FROM spreads)")


def _pair(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


_register("feature_correlation", "feature_x:s feature_y:s correlation:d", lambda b: signals.feature_correlation(b.panel, signals.CORE_FEATURES), "(" + " UNION ALL ".join(f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {_pair(x, y)} AS correlation FROM panel" for x in signals.CORE_FEATURES for y in signals.CORE_FEATURES) + ")")
_RANKED = [*FEATURES, *signals.TARGETS]
_register("spearman_matrix", "feature_x:s feature_y:s n_obs:i spearman:d", lambda b: signals.spearman_matrix(b.panel, _RANKED),
          "(" + " UNION ALL ".join(f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, count(*) AS n_obs, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS spearman FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2 AS ry FROM panel WHERE {x} IS NOT NULL AND {y} IS NOT NULL)" for i, x in enumerate(_RANKED) for y in _RANKED[i + 1 :]) + ")")
_W = [*FEATURES, *signals.TARGETS]
_wcols = " ".join(f"{c}:d" for c in _W)
_wsql = {"cuts": "SELECT month, " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi, count({c}) AS {c}_n" for c in _W) + " FROM panel GROUP BY ALL",
         "winsor": "SELECT p.month, permno, " + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c}_n >= 50 THEN least(greatest({c}, {c}_lo), {c}_hi) ELSE {c} END AS {c}" for c in _W) + " FROM panel p LEFT JOIN cuts USING (month)"}
_register("winsor_by_month", f"month:s permno:i {_wcols}", lambda b: stats.winsorize(b.panel, ["month"], _W, min_n=50), "winsor", _wsql)
_zsql = _wsql | {"zs": "SELECT month, permno, " + ", ".join(f"({c} - avg({c}) OVER (PARTITION BY month)) / nullif(stddev_samp({c}) OVER (PARTITION BY month), 0) AS z_{c}" for c in _W) + " FROM panel"}
_register("zscore_by_month", "month:s permno:i " + " ".join(f"z_{c}:d" for c in _W), lambda b: stats.zscore(b.panel, ["month"], _W), "zs", _zsql)
_register("interactions", "month:s permno:i z_owner_hhi_x_z_stock_sell_pressure:d", lambda b: stats.products(stats.zscore(b.panel, ["month"], _W), [("z_owner_hhi", "z_stock_sell_pressure")]), "(SELECT *, z_owner_hhi * z_stock_sell_pressure AS z_owner_hhi_x_z_stock_sell_pressure FROM zs)", _zsql)
_register("robust_z_by_month", "month:s permno:i " + " ".join(f"rz_{c}:d" for c in _W), lambda b: stats.robust_zscore(b.panel, ["month"], _W),
          "(SELECT p.month, permno, " + ", ".join(f"least(greatest(coalesce(({c} - {c}_m) / nullif({c}_s, 0), 0), -5), 5) AS rz_{c}" for c in _W) + " FROM panel p LEFT JOIN marks USING (month))", {"marks": "SELECT month, " + ", ".join(f"median({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in _W) + " FROM panel GROUP BY ALL"})
_register("fmb_univariate", "feature:s target:s month:s n_obs:i slope:d intercept:d r2:d adj_r2:d", lambda b: eco.fama_macbeth_univariate(b.long), "uni")
_register("fmb_summary_univariate", "feature:s target:s months:i mean_coef:d nw_se:d nw_t:d coef_std:d positive_month_share:d", lambda b: eco.fmb_summary(eco.fama_macbeth_univariate(b.long), ["feature", "target"], value="slope"),
          f"(SELECT a.feature, a.target, a.n AS months, mean AS mean_coef, se AS nw_se, t AS nw_t, std AS coef_std, positive_month_share FROM {newey_west('uni', 'feature, target', 'month', 'slope')} a JOIN (SELECT feature, target, avg((slope > 0)::INTEGER) AS positive_month_share FROM uni GROUP BY ALL) USING (feature, target))")


def _specs(b: Build) -> DataFrame:
    """Coefficients of all specifications and targets on winsorised z-scores, made once for each build."""
    if "coefficients" not in vars(b):
        b.coefficients = _coefficients(b)
    return b.coefficients


def _coefficients(b: Build) -> DataFrame:
    named = lambda xs: [f"z_{x}" for x in xs]
    grid = eco.spec_grid(named(DIRECT), named(NETWORK), named(MECHANISM), named(signals.CONTROLS), [f"z_{x}_x_z_{y}" for x, y in PAIRS])
    return written(eco.fama_macbeth_grid(b.winsorized_z, signals.TARGETS, grid, least=30, per_regressor=4), "coefficients")


_register("fmb_multivariate", "spec:s target:s variable:s months:i mean_coef:d nw_se:d nw_t:d coef_std:d positive_month_share:d", lambda b: eco.fmb_summary(_specs(b), ["spec", "target", "variable"]))
#: Specifications whose regressors are few enough for SQL to take them out of each other one by one. Selling pressure has months of the
#: smallest sample in which it doesn't vary among the stocks with a return; such months have a least-norm fit, which SQL hasn't.
_SMALL = {"network_core": [f"z_{x}" for x in [*NETWORK, *signals.CONTROLS]]} | {f"univariate__z_{x}": [f"z_{x}"] for x in [*DIRECT, *NETWORK] if x != "stock_sell_pressure"}
_SMALL_SQL = _wsql | {"wz": "SELECT month, fwd_ret_1m, fwd_ret_3m, " + ", ".join(f"({c} - avg({c}) OVER (PARTITION BY month)) / nullif(stddev_samp({c}) OVER (PARTITION BY month), 0) AS z_{c}" for c in FEATURES) + " FROM winsor"}
_small_parts = []
for _i, (_spec, _xs) in enumerate(_SMALL.items()):
    for _t in signals.TARGETS:
        _SMALL_SQL |= ols(f"fit_{_i}_{_t}", "wz", "month", _t, _xs, max(30, 4 * (len(_xs) + 1)))
        _small_parts.append(f"SELECT '{_spec}' AS spec, '{_t}' AS target, * FROM fit_{_i}_{_t}")
_SMALL_SQL["small_fits"] = " UNION ALL ".join(_small_parts)
_register("fmb_small_specs", "spec:s target:s variable:s months:i mean_coef:d nw_se:d nw_t:d coef_std:d positive_month_share:d", lambda b: eco.fmb_summary(_specs(b).where(F.col("spec").isin(*_SMALL)), ["spec", "target", "variable"]),
          f"(SELECT a.spec, a.target, a.variable, a.n AS months, mean AS mean_coef, se AS nw_se, t AS nw_t, std AS coef_std, positive_month_share FROM {newey_west('small_fits', 'spec, target, variable', 'month', 'coef')} a JOIN (SELECT spec, target, variable, avg((coef > 0)::INTEGER) AS positive_month_share FROM small_fits GROUP BY ALL) USING (spec, target, variable))", _SMALL_SQL)
_register("fmb_small_models", "spec:s target:s months:i mean_n:d min_n:i mean_adj_r2:d median_adj_r2:d", lambda b: eco.fmb_model_summary(_specs(b).where(F.col("spec").isin(*_SMALL)), ["spec", "target"]),
          "(SELECT spec, target, count(*) AS months, avg(n_obs) AS mean_n, min(n_obs) AS min_n, avg(adj_r2) AS mean_adj_r2, median(adj_r2) AS median_adj_r2 FROM small_fits WHERE variable = 'const' GROUP BY ALL)", _SMALL_SQL)
_register("fmb_strongest", "spec:s target:s variable:s months:i mean_coef:d nw_t:d positive_month_share:d", lambda b: eco.strongest(eco.fmb_summary(_specs(b), ["spec", "target", "variable"]), target="fwd_ret_1m", controls=[f"z_{c}" for c in signals.CONTROLS]))
_register("fmb_model_summary", "spec:s target:s months:i mean_n:d min_n:i mean_adj_r2:d median_adj_r2:d", lambda b: eco.fmb_model_summary(_specs(b), ["spec", "target"]))
_FACTORS = {"thirds": "SELECT month, ret, row_number() OVER (PARTITION BY month ORDER BY mktcap_proxy, permno) / count(*) OVER (PARTITION BY month) AS size, row_number() OVER (PARTITION BY month ORDER BY prc, permno) / count(*) OVER (PARTITION BY month) AS price FROM monthly WHERE ret IS NOT NULL",
            "fac": "SELECT * FROM (SELECT month, avg(ret) AS mktrf, avg(CASE WHEN size <= 1.0::DOUBLE / 3 THEN ret END) - avg(CASE WHEN size > 2.0::DOUBLE / 3 THEN ret END) AS smb, avg(CASE WHEN price > 2.0::DOUBLE / 3 THEN ret END) - avg(CASE WHEN price <= 1.0::DOUBLE / 3 THEN ret END) AS hml FROM thirds GROUP BY month) WHERE mktrf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL",
            "factors": "SELECT month, " + ", ".join(f"{f} / (SELECT CASE WHEN median(abs({f})) > 0.5 THEN 100 ELSE 1 END FROM fac) AS {f}" for f in ("mktrf", "smb", "hml")) + " FROM fac"}
_register("factors", "month:s mktrf:d smb:d hml:d", lambda b: b.factors, "factors", _FACTORS)
_HAC = _FACTORS | {"folio_factors": "SELECT f.*, mktrf FROM folio f JOIN factors USING (month)"} | hac("market", "folio_factors", "model, target", "month", "gross_dollar_neutral_return", ["mktrf"])
_register("hac_regression", "model:s target:s n:i r2:d variable:s coef:d t:d", lambda b: eco.hac_regression(b.folio.join(b.factors, "month"), ["model", "target"], "month", "gross_dollar_neutral_return", ["mktrf"]), "market", _HAC)
_ATTRIBUTION = _FACTORS | {"series_factors": "SELECT s.model, s.target, s.return_series, s.month, s.r, mktrf, smb, hml FROM series s JOIN factors USING (month) WHERE return_series IN ('gross_dollar_neutral_return', 'net_return_25bps')"} | hac("three", "series_factors", "model, target, return_series", "month", "r", ["mktrf", "smb", "hml"]) | {"attributed": f"SELECT *, CASE WHEN variable = 'const' THEN {annualizing()} * coef END AS annualized FROM three"}
_split = lambda t, h: f"SELECT '{t}' AS target, y AS test_year, f - {h} - {VALID} - {h} AS train_end, f - {h} - {VALID} AS valid_start, f - {h} AS valid_end, f AS first_test FROM (SELECT substring(month, 1, 4)::INTEGER AS y, min(i) AS f FROM numbered WHERE n_{t} > 0 GROUP BY 1)"
_register("splits", "target:s test_year:n train_end:n valid_start:n valid_end:n first_test:n", lambda b: b.splits,
          f"(SELECT * FROM ({_split('fwd_ret_1m', 1)} UNION ALL {_split('fwd_ret_3m', 3)}) WHERE train_end >= {MIN_TRAIN})", {"numbered": "SELECT *, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT month, count(fwd_ret_1m) AS n_fwd_ret_1m, count(fwd_ret_3m) AS n_fwd_ret_3m FROM panel GROUP BY month)"})
_PRED = "model:s target:s test_year:n month:s permno:i prediction:d actual_return:d"
_register("ridge_oos", _PRED, lambda b: b.ridge)
_register("boosted_oos", _PRED, lambda b: b.boosted)
_register("feature_importance", "target:s feature:s mean_importance:d", lambda b: reduce(DataFrame.unionByName, (models.feature_importance(b.features_z, b.splits_of(t), t, b.model_features) for t in signals.TARGETS)))
_register("tree_importance", "model:s target:s test_year:n feature:s gain:d rise:d", lambda b: b.tree_importance)
_register("mean_tree_importance", "target:s feature:s gain:d rise:d models:i", lambda b: models.mean_importance(b.tree_importance))
_register("model_eval", "model:s target:s oos_rows:i months:i r2_vs_zero:d sign_hit_rate:d rank_ic_mean:d rank_ic_nw_t:d spread_mean:d spread_nw_t:d annualized_spread_approx:d", lambda b: models.oos_eval(b.modelled))
_register("ridge_eval", "model:s target:s oos_rows:i months:i r2_vs_zero:d sign_hit_rate:d rank_ic_mean:d rank_ic_nw_t:d spread_mean:d spread_nw_t:d annualized_spread_approx:d", lambda b: models.oos_eval(b.ridge))
_rc = {"ics": "SELECT model, target, month, count(*) AS n, covar_pop(rp, ra) / nullif(stddev_pop(rp) * stddev_pop(ra), 0) AS rank_ic FROM (SELECT *, rank() OVER (PARTITION BY model, target, month ORDER BY prediction) + (count(*) OVER (PARTITION BY model, target, month, prediction) - 1) / 2 AS rp, rank() OVER (PARTITION BY model, target, month ORDER BY actual_return) + (count(*) OVER (PARTITION BY model, target, month, actual_return) - 1) / 2 AS ra FROM predictions) GROUP BY ALL HAVING count(*) >= 20",
       "ics_ok": "SELECT * FROM ics WHERE rank_ic IS NOT NULL",
       "ds": "SELECT *, high - low AS high_minus_low FROM (SELECT model, target, month, avg(CASE WHEN decile = 1 THEN actual_return END) AS low, avg(CASE WHEN decile = 10 THEN actual_return END) AS high, count(*) AS n FROM (SELECT *, least(greatest(ceil(share * 10), 1), 10) AS decile FROM placed) GROUP BY ALL)"}
_register("spearman_ic", "model:s target:s month:s n:i rank_ic:d", lambda b: models.spearman_ic_monthly(b.predictions), "ics_ok", _rc)
_register("decile_spread", "model:s target:s month:s low:d high:d n:i high_minus_low:d", lambda b: models.decile_spread_monthly(b.predictions), "ds", _rc)
_register("oos_eval", "model:s target:s oos_rows:i months:i r2_vs_zero:d sign_hit_rate:d rank_ic_mean:d rank_ic_nw_t:d spread_mean:d spread_nw_t:d annualized_spread_approx:d", lambda b: models.oos_eval(b.predictions),
          f"(SELECT a.*, i.mean AS rank_ic_mean, i.t AS rank_ic_nw_t, s.mean AS spread_mean, s.t AS spread_nw_t, (CASE WHEN target LIKE '%3m' THEN 4.0 ELSE 12.0 END) * s.mean AS annualized_spread_approx FROM (SELECT model, target, count(*) AS oos_rows, count(DISTINCT month) AS months, 1 - sum((actual_return - prediction) * (actual_return - prediction)) / nullif(sum(actual_return * actual_return), 0) AS r2_vs_zero, avg((sign(actual_return) = sign(prediction))::INTEGER) AS sign_hit_rate FROM predictions GROUP BY ALL) a LEFT JOIN {newey_west('ics_ok', 'model, target', 'month', 'rank_ic')} i USING (model, target) LEFT JOIN {newey_west('ds', 'model, target', 'month', 'high_minus_low')} s USING (model, target))", _rc)
_register("best_models", "model:s target:s rank_ic_mean:d place:n", lambda b: models.best_models(models.oos_eval(b.predictions)),
          f"(SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank_ic_mean DESC NULLS LAST, model) AS place FROM (SELECT model, target, mean AS rank_ic_mean FROM {newey_west('ics_ok', 'model, target', 'month', 'rank_ic')}) QUALIFY place <= 3)", _rc)
_register("decile_portfolio", "model:s target:s month:s gross_dollar_neutral_return:d short_leg_mean_return:d long_leg_mean_return:d n_short:i n_long:i academic_spread_return:d", lambda b: portfolio.decile_portfolio(b.book), "folio")
_register("turnover", "model:s target:s month:s turnover_abs_change:d turnover_one_way:d gross_exposure:d net_exposure:d n_names:i", lambda b: portfolio.turnover(b.book), "turn")
_register("net_returns", "model:s target:s month:s " + " ".join(f"net_return_{c}bps:d" for c in portfolio.COST_BPS), lambda b: b.folio, "costed")
_FALL = "model:s target:s return_series:s max_drawdown:d max_drawdown_peak_month:s max_drawdown_trough_month:s"
_PERF = f"{_FALL} months:i hit_rate:d cumulative_return:d avg_turnover_abs_change:d avg_turnover_one_way:d avg_n_long:d avg_n_short:d mean_period_return:d nw_t_mean:d annualized_mean_return:d annualized_volatility:d sharpe_approx:d"
_register("performance_summary", _PERF, lambda b: b.performance, "perf")
_register("max_drawdown", _FALL, lambda b: b.performance, "perf")
_register("cost_sensitivity", "model:s target:s cost_bps:n months:i annualized_mean_return:d nw_t_mean:d cumulative_return:d avg_turnover_abs_change:d", lambda b: portfolio.cost_sensitivity(b.folio), "(SELECT *, regexp_extract(return_series, '([0-9]+)bps', 1)::INTEGER AS cost_bps FROM perf WHERE return_series LIKE 'net%')")
_register("ridge_performance", _PERF, lambda b: b.ridge_performance)
_register("ridge_network_delta", "target:s comparison:s delta_net25_annualized_mean_return:d delta_net25_sharpe:d delta_net25_cumulative_return:d", lambda b: robustness.incremental_delta(robustness.model_comparison(b.ridge_performance), "ridge_all", "ridge_no_network"))
_register("model_portfolio_performance", _PERF, lambda b: b.model_performance)
_register("boosted_network_delta", "target:s comparison:s delta_net25_annualized_mean_return:d delta_net25_sharpe:d delta_net25_cumulative_return:d", lambda b: robustness.incremental_delta(robustness.model_comparison(b.model_performance), "boosted_all", "boosted_no_network"))
_register("holding_counts", "model:s target:s month:s side:n names:i", lambda b: portfolio.holding_counts(b.book), "(SELECT model, target, month, side, count(*) AS names FROM book GROUP BY ALL)")
_register("select_headline", _PERF, lambda b: portfolio.select_headline(b.performance), "(SELECT * FROM perf ORDER BY (target = 'fwd_ret_1m' AND return_series = 'net_return_25bps')::INTEGER DESC, sharpe_approx DESC NULLS LAST, annualized_mean_return DESC NULLS LAST, model, target, return_series LIMIT 1)")
_register("factor_attribution", "model:s target:s return_series:s n:i r2:d variable:s coef:d t:d annualized:d", lambda b: portfolio.factor_attribution(b.folio, b.factors), "attributed", _ATTRIBUTION)
_register("model_factor_attribution", "model:s target:s return_series:s n:i r2:d variable:s coef:d t:d annualized:d", lambda b: portfolio.factor_attribution(b.model_folio, b.factors, least=24))


def _register_metrics(name: str, by: str, source: Callable[[Build], DataFrame], cte: str, extra: dict[str, str]):
    names = "rows:i months:i avg_top_names:d avg_bottom_names:d rank_ic_mean:d rank_ic_t_hac6:d spread_mean:d spread_t_hac6:d hit_rate_mean:d hit_rate_t_hac6:d annualized_spread_approx:d annualized_spread_to_vol_proxy:d"
    _register(name, " ".join(f"{c}:s" for c in by.split(", ")) + " " + names, source)
    ORACLE_SQL[name] = with_ctes(metrics(cte, by, METRIC_ROWS), extra)


_regimes = "SELECT *, CASE WHEN y <= 2016 THEN '2012_2016_early_oos' WHEN y <= 2019 THEN '2017_2019_pre_covid' WHEN y <= 2020 THEN '2020_covid' WHEN y <= 2022 THEN '2021_2022_rate_hike' ELSE '2023_2025_recent' END AS regime FROM (SELECT *, substring(month, 1, 4)::INTEGER AS y FROM predictions)"
_register_metrics("regime_metrics", "model, target, regime", lambda b: robustness.regime_metrics(b.predictions, least=METRIC_ROWS), "in_regime", {"by_year": _regimes, "in_regime": "SELECT * FROM by_year UNION ALL SELECT * REPLACE ('all_oos' AS regime) FROM by_year"})
_METRICS = "rows:i months:i rank_ic_mean:d rank_ic_t_hac6:d spread_mean:d spread_t_hac6:d hit_rate_mean:d annualized_spread_approx:d"
_register("model_regime_metrics", f"model:s target:s regime:s {_METRICS}", lambda b: robustness.regime_metrics(b.modelled, least=METRIC_ROWS))
_register("model_stratum_metrics", f"model:s target:s stratum:s {_METRICS}", lambda b: robustness.stratum_metrics(b.modelled, b.panel, "avg_manager_breadth", least=METRIC_ROWS))
_register("tercile_strata", "month:s permno:i stratum:s", lambda b: robustness.tercile_strata(b.panel, "mktcap_proxy"), "strata", {"strata": strata("mktcap_proxy")})
_register_metrics("stratum_metrics", "model, target, stratum", lambda b: robustness.stratum_metrics(b.predictions, b.panel, "avg_manager_breadth", least=METRIC_ROWS), "in_stratum", {"strata": strata("avg_manager_breadth"), "in_stratum": "SELECT p.*, s.stratum FROM predictions p JOIN strata s ON p.month = s.month AND p.permno = s.permno WHERE s.stratum <> 'missing'"})
_register("permutation_placebo", "model:s target:s actual_rank_ic_mean:d actual_rank_ic_t_hac6:d placebo_rank_ic_mean:d placebo_rank_ic_t_hac6:d rank_ic_gap_actual_minus_placebo:d spread_gap_actual_minus_placebo:d", lambda b: robustness.permutation_placebo(b.predictions, least=METRIC_ROWS))
_register("model_comparison", f"{_PERF} rank_by_sharpe_within_target:n", lambda b: robustness.model_comparison(b.performance), "compared")
_SCORE = "oos_rank_ic_mean:d oos_rank_ic_t_hac6:d oos_annualized_spread_approx:d oos_spread_t_hac6:d net25_annualized_mean_return:d net25_sharpe_approx:d net25_nw_t_mean:d net25_cumulative_return:d net25_max_drawdown:d factor_alpha_annualized:d factor_alpha_t_hac6:d factor_r2:d factor_beta_mktrf:d factor_beta_smb:d factor_beta_hml:d"
_PLACEBO = "placebo_rank_ic_mean:d placebo_rank_ic_t_hac6:d rank_ic_gap_actual_minus_placebo:d spread_gap_actual_minus_placebo:d"


def _card(b: Build) -> DataFrame:
    if "card" not in vars(b):
        b.card = written(robustness.scorecard(b.predictions, robustness.model_comparison(b.performance), portfolio.factor_attribution(b.folio, b.factors), least=METRIC_ROWS), "scorecard")
    return b.card


_register("scorecard", f"model:s target:s {_SCORE} {_PLACEBO}", _card)
# the placebo is ordered by a hash that SQL doesn't have; all other columns are checked here
_fit = ", ".join(f"max(CASE WHEN variable = '{v}' THEN {c} END) AS {n}" for v, c, n in (("const", "annualized", "factor_alpha_annualized"), ("const", "t", "factor_alpha_t_hac6"), *((f, "coef", f"factor_beta_{f}") for f in ("mktrf", "smb", "hml"))))
_register("scorecard_without_placebo", f"model:s target:s {_SCORE}", _card,
          "(SELECT m.model, m.target, rank_ic_mean AS oos_rank_ic_mean, rank_ic_t_hac6 AS oos_rank_ic_t_hac6, annualized_spread_approx AS oos_annualized_spread_approx, spread_t_hac6 AS oos_spread_t_hac6, c.annualized_mean_return AS net25_annualized_mean_return, c.sharpe_approx AS net25_sharpe_approx, c.nw_t_mean AS net25_nw_t_mean, c.cumulative_return AS net25_cumulative_return, c.max_drawdown AS net25_max_drawdown, f.* EXCLUDE (model, target) FROM whole_metrics m LEFT JOIN compared c ON m.model = c.model AND m.target = c.target LEFT JOIN fits f ON m.model = f.model AND m.target = f.target)",
          _ATTRIBUTION | {"whole_metrics": metrics("predictions", "model, target", METRIC_ROWS), "fits": f"SELECT model, target, max(r2) AS factor_r2, {_fit} FROM attributed WHERE return_series = 'net_return_25bps' GROUP BY model, target"})
_register("model_scorecard", f"model:s target:s {_SCORE} {_PLACEBO}", lambda b: robustness.scorecard(b.modelled, robustness.model_comparison(b.model_performance), portfolio.factor_attribution(b.model_folio, b.factors, least=24), least=METRIC_ROWS))
_register("incremental_delta", "target:s comparison:s delta_net25_annualized_mean_return:d delta_net25_sharpe:d delta_net25_cumulative_return:d", lambda b: robustness.incremental_delta(robustness.model_comparison(b.performance)),
          "(SELECT a.target, 'all_minus_no_network' AS comparison, a.annualized_mean_return - b.annualized_mean_return AS delta_net25_annualized_mean_return, a.sharpe_approx - b.sharpe_approx AS delta_net25_sharpe, a.cumulative_return - b.cumulative_return AS delta_net25_cumulative_return FROM compared a JOIN compared b ON a.target = b.target AND a.model = 'all' AND b.model = 'no_network')")
_register("profile_source", "column:s rows:i non_null_rate:d distinct_values:i min_date:D max_date:D", lambda b: quality.profile_source(b.holdings, ["manager_id", "cusip8", "filing_date"], ["filing_date"]),
          "(" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count({c}) / nullif(count(*), 0) AS non_null_rate, count(DISTINCT {c}) AS distinct_values, {'min(filing_date)' if c == 'filing_date' else 'NULL::DATE'} AS min_date, {'max(filing_date)' if c == 'filing_date' else 'NULL::DATE'} AS max_date FROM holdings" for c in ("manager_id", "cusip8", "filing_date")) + ")")


def _metric_rows(source: str, **values: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::DOUBLE AS value FROM {source}" for k, v in values.items()) + ")"


_register("audit_holdings", "metric:s value:d", lambda b: quality.audit_holdings(b.holdings), _metric_rows("holdings", lag_mean="avg(filing_lag_days)", lag_p05="quantile_cont(filing_lag_days, 0.05)", lag_p50="quantile_cont(filing_lag_days, 0.5)", lag_p95="quantile_cont(filing_lag_days, 0.95)", lag_min="min(filing_lag_days)", lag_max="max(filing_lag_days)", shares_positive_rate="avg((shares > 0)::INTEGER)", negative_lag_share="avg((filing_lag_days < 0)::INTEGER)"))
_register("audit_key_overlap", "metric:s value:d", lambda b: quality.audit_key_overlap(b.holdings, b.names.where("is_common_stock"), "cusip8"),
          "(SELECT 'left_keys' AS metric, count(DISTINCT cusip8)::DOUBLE AS value FROM holdings UNION ALL SELECT 'right_keys', count(DISTINCT cusip8) FROM names WHERE is_common_stock UNION ALL SELECT 'common_keys', count(DISTINCT cusip8) FROM holdings WHERE cusip8 IN (SELECT cusip8 FROM names WHERE is_common_stock) UNION ALL SELECT 'left_row_overlap_rate', avg((cusip8 IN (SELECT cusip8 FROM names WHERE is_common_stock))::INTEGER) FROM holdings)")
_register("audit_universe", "metric:s value:d", lambda b: quality.audit_universe(b.names), _metric_rows("names", common_share_rate="avg((shrcd IN (10, 11))::INTEGER)", **{f"exchange_{k}_rate": f"avg((exchcd = {k})::INTEGER)" for k in (1, 2, 3)}))
_register("audit_returns", "metric:s value:d", lambda b: quality.audit_returns(b.monthly), _metric_rows("monthly", ret_p01="quantile_cont(ret, 0.01)", ret_p50="quantile_cont(ret, 0.5)", ret_p99="quantile_cont(ret, 0.99)", price_at_least_5_rate="avg((abs(prc) >= 5)::INTEGER)"))
def _gate_sql(minimums: dict[str, float]) -> dict[str, str]:
    measured = "SELECT 'clean_holdings_rows' AS metric, count(*)::DOUBLE AS value FROM holdings UNION ALL SELECT 'common_mapping_rate', (SELECT count(*) FROM mapped) / greatest((SELECT count(*) FROM holdings), 1)::DOUBLE UNION ALL SELECT 'panel_months', count(DISTINCT month) FROM panel UNION ALL SELECT 'panel_rows', count(*) FROM panel UNION ALL SELECT 'fwd_ret_1m_coverage', avg((fwd_ret_1m IS NOT NULL)::INTEGER) FROM panel UNION ALL SELECT 'median_owner_count', median(owner_count) FROM panel"
    return {"measured": measured, "wanted": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in minimums.items()) + ") t(metric, threshold)"}


#: The second gate's minimums fit the sample, so that it passes.
for _name, _minimums in (("quality_gate", MINIMUMS), ("quality_gate_of_sample", MINIMUMS | {"panel_rows": 1000})):
    _register(_name, "metric:s value:d threshold:d ok:b status:s", lambda b, m=_minimums: quality.quality_gate(quality.build_metrics(b.holdings, b.mapped, b.positions, b.panel), m),
              "(SELECT *, CASE WHEN min(ok::INTEGER) OVER () = 1 THEN 'ok' ELSE 'needs_attention' END AS status FROM (SELECT metric, value, threshold, coalesce(value >= threshold, false) AS ok FROM wanted LEFT JOIN measured USING (metric)))", _gate_sql(_minimums))


def _labelled(b: Build, target: str) -> DataFrame:
    names = vars(b).setdefault("labelled", {})
    if target not in names:
        names[target] = written(downside.downside_labels(b.features_z, target), "labelled")
    return names[target]


def _logistic(b: Build) -> DataFrame:
    """Out-of-sample chances of a fall for both targets and all feature sets."""
    if "logistic" not in vars(b):
        sets = models.feature_sets(b.model_features)
        b.logistic = written(reduce(DataFrame.unionByName, (downside.logistic_oos(_labelled(b, t), b.splits_of(t), t, xs, model=f"logistic_{x}") for t in signals.TARGETS for x, xs in sets.items())), "logistic")
    return b.logistic


def _plain_scores(b: Build) -> DataFrame:
    """The plain scores as chances of a fall: a low score is a high one."""
    rows = b.predictions.withColumnRenamed("actual_return", "y")
    place = F.row_number().over(Window.partitionBy("model", "target", "month").orderBy("y", "permno")) / F.count(F.lit(1)).over(Window.partitionBy("model", "target", "month"))
    return rows.select("model", "target", "month", "permno", (-F.col("prediction")).alias("prediction"), (place <= downside.WORST).cast("int").alias("downside"))


_FALLS = {"falls_of": f"SELECT model, target, month, permno, -prediction AS p, (row_number() OVER (PARTITION BY model, target, month ORDER BY actual_return, permno) / count(*) OVER (PARTITION BY model, target, month) <= {downside.WORST}::DOUBLE)::INTEGER AS d FROM predictions",
          "fall_ranks": "SELECT *, rank() OVER (PARTITION BY model, target, month ORDER BY p) + (count(*) OVER (PARTITION BY model, target, month, p) - 1) / 2 AS r FROM falls_of",
          "aucs": "SELECT model, target, month, n, falls, (ranks - falls * (falls + 1) / 2) / (falls * (n - falls)) AS auc FROM (SELECT model, target, month, count(*) AS n, sum(d) AS falls, sum(r * d) AS ranks FROM fall_ranks GROUP BY ALL) WHERE falls > 0 AND falls < n",
          "auc_excess": "SELECT *, auc - 0.5::DOUBLE AS excess FROM aucs"}
_AUC = "model:s target:s month:s n:i falls:i auc:d"
_AUC_SUMMARY = "model:s target:s months:i mean_auc:d excess_t:d"
_register("downside_labels", "month:s permno:i downside:n", lambda b: downside.downside_labels(b.panel, "fwd_ret_1m"), f"(SELECT month, permno, (row_number() OVER (PARTITION BY month ORDER BY fwd_ret_1m, permno) / count(*) OVER (PARTITION BY month) <= {downside.WORST}::DOUBLE)::INTEGER AS downside FROM panel WHERE fwd_ret_1m IS NOT NULL)")
_register("downside_auc_of_scores", _AUC, lambda b: downside.auc_monthly(_plain_scores(b)), "aucs", _FALLS)
_register("downside_auc_summary", _AUC_SUMMARY, lambda b: downside.auc_summary(downside.auc_monthly(_plain_scores(b))), f"(SELECT model, target, n AS months, mean + 0.5::DOUBLE AS mean_auc, t AS excess_t FROM {newey_west('auc_excess', 'model, target', 'month', 'excess')})", _FALLS)
_register("downside_logistic_oos", "model:s target:s test_year:n month:s permno:i prediction:d downside:n", _logistic)
_register("downside_logistic_auc", _AUC, lambda b: downside.auc_monthly(_logistic(b)))
_register("downside_logistic_summary", _AUC_SUMMARY, lambda b: downside.auc_summary(downside.auc_monthly(_logistic(b))))

# Returns over trading days, and up to the end of a listing.
_HORIZON = {
    "daily0": "SELECT permno, day AS date, avg(l_extendedprice / l_quantity) AS prc FROM trades GROUP BY ALL",
    "daily1": "SELECT *, prc / lag(prc) OVER (PARTITION BY permno ORDER BY date) - 1 AS ret FROM daily0",
    "open_days": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_index FROM (SELECT DISTINCT date FROM daily1)",
    "daily2": "SELECT * FROM daily1 JOIN open_days USING (date)",
    "daily": "SELECT *, " + ", ".join(f"CASE WHEN day_index + {h} <= (SELECT max(day_index) FROM open_days) THEN product(1 + ret) OVER (PARTITION BY permno ORDER BY day_index RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING) - 1 END AS fwd_ret_{h}d" for h in horizons.HORIZONS) + " FROM daily2",
    "month_ends": "SELECT month, permno, " + ", ".join(f"fwd_ret_{h}d" for h in horizons.HORIZONS) + " FROM (SELECT *, strftime(date, '%Y-%m') AS month, row_number() OVER (PARTITION BY permno, date_trunc('month', date) ORDER BY date DESC) AS place FROM daily) WHERE place = 1",
    "horizon_long": " UNION ALL ".join(f"SELECT month, permno, feature, 'fwd_ret_{h}d' AS target, x, round(fwd_ret_{h}d, 8) AS y FROM long_features JOIN month_ends USING (month, permno) WHERE x IS NOT NULL AND isfinite(x) AND fwd_ret_{h}d IS NOT NULL AND isfinite(fwd_ret_{h}d)" for h in horizons.HORIZONS),
    "horizon_ic": f"SELECT feature, target, month, count(*) AS n_obs, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rank_ic FROM (SELECT *, percent_rank() OVER (PARTITION BY feature, target, month ORDER BY x) AS rx, percent_rank() OVER (PARTITION BY feature, target, month ORDER BY y) AS ry FROM horizon_long) GROUP BY ALL HAVING count(*) >= {METRIC_ROWS}",
    "events": "SELECT permno, day + [0, 40, -70][(permno % 4 % 3 + 1)::INTEGER]::INTEGER AS date, coalesce(CASE WHEN permno % 5 <> 0 THEN (permno % 7) / 10.0::DOUBLE - 0.5::DOUBLE END, -0.3::DOUBLE) AS dlret FROM (SELECT permno, max(day) AS day FROM trades WHERE permno % 3 = 0 GROUP BY ALL)",
    "lasts": "SELECT m.permno, max(m.month_date) AS last_month FROM monthly0 m GROUP BY ALL",
    "ends": "SELECT permno, date, dlret, last_month, date_trunc('month', date)::DATE AS month_date FROM events JOIN lasts USING (permno) WHERE date_trunc('month', date) >= last_month",
    "stitched": "SELECT m.permno, m.date, m.month, CASE WHEN e.permno IS NOT NULL THEN (1 + coalesce(m.ret, 0)) * (1 + e.dlret) - 1 ELSE m.ret END AS ret, e.permno IS NOT NULL AS delisted FROM monthly0 m LEFT JOIN ends e ON m.permno = e.permno AND m.month_date = e.month_date UNION ALL SELECT permno, date, strftime(date, '%Y-%m'), dlret, true FROM ends WHERE month_date > last_month",
    "placed_legs": "SELECT *, row_number() OVER (PARTITION BY permno ORDER BY date DESC) AS from_end, bool_or(delisted) OVER (PARTITION BY permno) AS ended, lead(ret) OVER w AS r1, lead(ret, 2) OVER w AS r2, lead(ret, 3) OVER w AS r3 FROM stitched WINDOW w AS (PARTITION BY permno ORDER BY date)",
    "to_the_end": "SELECT permno, month, ret, delisted, r1 AS fwd_ret_1m, (1 + r1) * (1 + CASE WHEN ended AND from_end <= 2 THEN 0 ELSE r2 END) * (1 + CASE WHEN ended AND from_end <= 3 THEN 0 ELSE r3 END) - 1 AS fwd_ret_3m FROM placed_legs",
}
_register("delisting_forward_returns", "permno:i month:s ret:d delisted:b fwd_ret_1m:d fwd_ret_3m:d", lambda b: b.to_the_end, "to_the_end", _HORIZON)
_register("daily_horizon_returns", "permno:i date:D day_index:i ret:d fwd_ret_21d:d fwd_ret_63d:d", lambda b: b.daily, "daily", _HORIZON)
_register("month_end_horizons", "month:s permno:i fwd_ret_21d:d fwd_ret_63d:d", lambda b: horizons.month_end_horizons(b.daily), "month_ends", _HORIZON)
_register("horizon_rank_ic", "feature:s target:s month:s n_obs:i rank_ic:d", lambda b: signals.rank_ic_monthly(b.horizon_long, least=METRIC_ROWS), "horizon_ic", _HORIZON)
