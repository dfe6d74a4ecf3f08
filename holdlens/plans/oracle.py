"""The SQL of the registered queries, as common table expressions that build on each other."""

from __future__ import annotations

import re

from holdlens.operators.portfolio import COST_BPS
from holdlens.operators.signals import CONTROLS, CORE_FEATURES, NEGATIVE, TARGETS
from holdlens.sources.sample import END, START

FEATURES = [*CORE_FEATURES, *CONTROLS]


def r(x: str, name: str | None = None) -> str:
    """``x`` rounded as the queries round: 6 decimals, fewer where it is large, 9 digits from 1e9 on.

    A small shift keeps values that lie between two results from falling either way.
    """
    return f"(CASE WHEN abs({x}) >= 1e9 THEN printf('%.8e', ({x})::DOUBLE)::DOUBLE WHEN abs({x}) >= 1e6 THEN round({x} + 0.00137::DOUBLE, 2) WHEN abs({x}) >= 1000 THEN round({x} + 0.0000137::DOUBLE, 4) ELSE round({x} + 0.00000000137::DOUBLE, 6) + 0.0 END)::DOUBLE" + (f" AS {name}" if name else "")


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def ann(target: str = "target") -> str:
    return f"(CASE WHEN {target} LIKE '%3m' THEN 4.0 ELSE 12.0 END)"


def newey_west(cte: str, by: str, order: str, value: str, lags: int = 6) -> str:
    """A subquery with by, n, mean, se, t, std."""
    ks = range(1, lags + 1)
    var = "g0 + " + " + ".join(f"(CASE WHEN {k} <= l THEN 2 * (1 - {k} / (l + 1.0)) * g{k} ELSE 0 END)" for k in ks)
    return f"""(SELECT *, CASE WHEN se > 0 THEN mean / se END AS t FROM (
      SELECT {by}, n, mean, std, CASE WHEN n > 1 THEN sqrt(greatest(({var}) / n, 0) / n) END AS se FROM (
        SELECT {by}, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, least({lags}, count(x) - 1) AS l, sum(d * d) AS g0, {", ".join(f"coalesce(sum(d * d{k}), 0) AS g{k}" for k in ks)} FROM (
          SELECT *, {", ".join(f"lag(d, {k}) OVER (PARTITION BY {by} ORDER BY {order}) AS d{k}" for k in ks)} FROM (
            SELECT {by}, {order}, {value}::DOUBLE AS x, {value} - avg({value}) OVER (PARTITION BY {by}) AS d FROM {cte} WHERE {value} IS NOT NULL)) GROUP BY {by})))"""


_long_features = " UNION ALL ".join(f"SELECT month, permno, '{f}' AS feature, {f}::DOUBLE AS x, fwd_ret_1m, fwd_ret_3m FROM panel" for f in FEATURES)
_long = " UNION ALL ".join(f"SELECT month, permno, feature, '{t}' AS target, x, {t} AS y FROM long_features WHERE x IS NOT NULL AND isfinite(x) AND {t} IS NOT NULL AND isfinite({t})" for t in TARGETS)
direction = f"(CASE WHEN feature IN ({', '.join(repr(f) for f in sorted(NEGATIVE))}) THEN -1.0 ELSE 1.0 END)"
_q8 = lambda names: ", ".join(f"round({c}, 8) AS {c}" for c in names)

CTES: dict[str, str] = {
    "sec": "SELECT p_partkey, (CAST(substring(p_brand, 7) AS INTEGER) * 10 + dense_rank() OVER (ORDER BY p_type))::BIGINT AS permno FROM part",
    "trades": "SELECT permno, l_suppkey, l_quantity, l_extendedprice, l_shipdate::DATE AS day FROM lineitem JOIN sec ON l_partkey = p_partkey",
    "raw_h": "SELECT 'M' || l_suppkey AS manager_id, 'C' || lpad(permno::VARCHAR, 7, '0') AS cusip8, last_day(date_trunc('quarter', day)::DATE + INTERVAL 2 MONTH)::DATE AS report_date, l_suppkey, l_quantity AS shares, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS value FROM trades",
    "raw_d": "SELECT *, CASE WHEN l_suppkey % 11 <> 0 THEN report_date + (20 + l_suppkey % 50)::INTEGER END AS filing_date FROM raw_h",
    "holdings": f"SELECT manager_id, cusip8, report_date, filing_date, coalesce(filing_date, report_date + 45) AS available_date, report_date AS mapping_date, date_trunc('month', coalesce(filing_date, report_date + 45))::DATE AS available_month, year(report_date) || 'Q' || quarter(report_date) AS report_quarter, (coalesce(filing_date, report_date + 45) - report_date)::INTEGER AS filing_lag_days, sum(shares) AS shares, coalesce(sum(value), 0) AS reported_value FROM raw_d WHERE coalesce(filing_date, report_date + 45) BETWEEN DATE '{START}' AND DATE '{END}' AND shares > 0 GROUP BY ALL",
    "names": "SELECT permno, 'C' || lpad(permno::VARCHAR, 7, '0') AS cusip8, permno * 10 AS permco, a AS name_start, b AS name_end, (CASE WHEN permno % 7 = 0 THEN 31 ELSE k END)::INTEGER AS shrcd, (permno % 3 + 1)::INTEGER AS exchcd, 'T' || permno AS ticker, 'Company ' || permno AS comnam, permno % 7 <> 0 AS is_common_stock FROM (SELECT DISTINCT permno FROM sec), (VALUES (DATE '1900-01-01', DATE '1998-06-30', 10), (DATE '1998-07-01', DATE '2099-12-31', 11)) v(a, b, k)",
    "m0": "SELECT permno, last_day(day)::DATE AS date, avg(l_extendedprice / l_quantity) AS prc, sum(l_quantity) AS vol, count(*) * 1000.0::DOUBLE AS shrout FROM trades GROUP BY ALL",
    "m1": "SELECT *, prc / lag(prc) OVER (PARTITION BY permno ORDER BY date) - 1 AS ret FROM m0",
    "monthly0": "SELECT permno, date, permno * 10 AS permco, ret, ret - 0.001 AS retx, prc, shrout, vol, date_trunc('month', date)::DATE AS month_date, strftime(date, '%Y-%m') AS month, abs(prc) * shrout AS mktcap_proxy FROM m1",
    "monthly": "SELECT *, lead(ret) OVER w AS fwd_ret_1m, (1 + lead(ret) OVER w) * (1 + lead(ret, 2) OVER w) * (1 + lead(ret, 3) OVER w) - 1 AS fwd_ret_3m FROM monthly0 WINDOW w AS (PARTITION BY permno ORDER BY date)",
    "mapped": "SELECT h.*, n.permno, n.permco, n.shrcd, n.exchcd, n.ticker, n.comnam, n.is_common_stock FROM holdings h JOIN names n ON h.cusip8 = n.cusip8 AND h.mapping_date BETWEEN n.name_start AND n.name_end WHERE n.is_common_stock",
    "snap": "SELECT manager_id, permno, report_date, available_date, available_month, mapping_date, max(permco) AS permco, max(report_quarter) AS report_quarter, sum(shares) AS shares, sum(reported_value) AS reported_value, avg(filing_lag_days) AS filing_lag_days FROM mapped GROUP BY ALL",
    "filings": f"SELECT DISTINCT manager_id, report_date, available_date, available_month AS s FROM snap WHERE available_month <= DATE '{END}'",
    "ordered": "SELECT *, lead(s) OVER (PARTITION BY manager_id ORDER BY s, available_date, report_date) AS nxt FROM filings",
    "wins": "SELECT manager_id, report_date, available_date, s AS active_start_month, (CASE WHEN nxt > s THEN nxt - INTERVAL 1 MONTH ELSE s + INTERVAL 5 MONTH END)::DATE AS active_end_month FROM ordered",
    "months": "SELECT snap.*, unnest(generate_series(w.active_start_month::TIMESTAMP, w.active_end_month::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month_date FROM snap JOIN wins w ON snap.manager_id = w.manager_id AND snap.report_date IS NOT DISTINCT FROM w.report_date AND snap.available_date IS NOT DISTINCT FROM w.available_date",
    "expanded": "SELECT month_date, strftime(month_date, '%Y-%m') AS month, manager_id, permno, permco, report_date, available_date, report_quarter, shares, reported_value, filing_lag_days FROM (SELECT *, row_number() OVER (PARTITION BY month_date, manager_id, permno ORDER BY available_date DESC, report_date DESC) AS rn FROM months) WHERE rn = 1",
    "valued": "SELECT e.*, m.ret, m.retx, m.prc, m.shrout, m.vol, m.mktcap_proxy, m.fwd_ret_1m, m.fwd_ret_3m, CASE WHEN e.reported_value > 0 THEN e.reported_value WHEN abs(m.prc) > 0 THEN e.shares * abs(m.prc) ELSE e.shares END AS position_value_proxy FROM expanded e LEFT JOIN monthly m ON e.permno = m.permno AND e.month_date = m.month_date",
    "positions": "SELECT *, position_value_proxy / nullif(manager_total_value_proxy, 0) AS portfolio_weight, year(month_date)::INTEGER AS year FROM (SELECT *, sum(position_value_proxy) OVER (PARTITION BY month_date, manager_id) AS manager_total_value_proxy FROM valued WHERE position_value_proxy > 0) WHERE manager_total_value_proxy > 0",
    "mgr": "SELECT month_date, month, manager_id, count(DISTINCT permno) AS manager_breadth, sum(position_value_proxy) AS manager_total_value_proxy, sum(portfolio_weight * portfolio_weight) AS manager_concentration FROM positions GROUP BY ALL",
    "enriched": "SELECT *, greatest(coalesce(lag_position_value_proxy, position_value_proxy) - position_value_proxy, 0) AS sell_amount_proxy FROM (SELECT p.*, g.manager_breadth, g.manager_concentration, position_value_proxy / nullif(sum(position_value_proxy) OVER (PARTITION BY p.month_date, permno), 0) AS stock_owner_share, lag(position_value_proxy) OVER (PARTITION BY p.manager_id, permno ORDER BY p.month_date) AS lag_position_value_proxy FROM positions p LEFT JOIN mgr g ON p.month_date = g.month_date AND p.manager_id = g.manager_id)",
    "stock": "SELECT month_date, month, permno, max(permco) AS permco, count(DISTINCT manager_id) AS owner_count, sum(position_value_proxy) AS total_position_value_proxy, sum(stock_owner_share * stock_owner_share) AS owner_hhi, max(stock_owner_share) AS top_owner_share, avg(manager_concentration) AS fragility_proxy, avg(manager_breadth) AS avg_manager_breadth, sum(sell_amount_proxy) / nullif(sum(position_value_proxy), 0) AS stock_sell_pressure, max(ret) AS ret, max(retx) AS retx, max(prc) AS prc, max(shrout) AS shrout, max(vol) AS vol, max(mktcap_proxy) AS mktcap_proxy, max(fwd_ret_1m) AS fwd_ret_1m, max(fwd_ret_3m) AS fwd_ret_3m, year(month_date)::INTEGER AS year FROM enriched GROUP BY month_date, month, permno",
    "edges": "SELECT a.month, a.permno AS i, b.permno AS j, sum(a.portfolio_weight * b.portfolio_weight) AS g FROM positions a JOIN positions b ON a.month = b.month AND a.manager_id = b.manager_id AND a.permno < b.permno GROUP BY ALL",
    "both_ways": "SELECT month, i, j, g FROM edges UNION ALL SELECT month, j, i, g FROM edges",
    "net": "SELECT b.month, b.i AS permno, count(*) AS network_degree, sum(g) AS network_weighted_degree, sum(g * coalesce(s.stock_sell_pressure, 0)) / sum(g) AS network_peer_sell_pressure FROM both_ways b LEFT JOIN stock s ON s.month = b.month AND s.permno = b.j GROUP BY ALL",
    "held": "SELECT DISTINCT month, permno FROM positions",
    "network": "SELECT h.month, h.permno, coalesce(network_degree, 0) AS network_degree, coalesce(network_weighted_degree, 0) AS network_weighted_degree, coalesce(network_peer_sell_pressure, 0) AS network_peer_sell_pressure FROM held h LEFT JOIN net n ON h.month = n.month AND h.permno = n.permno",
    "panel0": "SELECT s.*, coalesce(n.network_degree, 0) AS network_degree, coalesce(n.network_weighted_degree, 0) AS network_weighted_degree, coalesce(n.network_peer_sell_pressure, 0) AS network_peer_sell_pressure FROM stock s LEFT JOIN network n ON s.month = n.month AND s.permno = n.permno",
    "panel": f"SELECT * REPLACE ({_q8([c for c in FEATURES if c not in ('owner_count', 'network_degree')] + TARGETS)}) FROM panel0",
    "long_features": _long_features,
    "long": _long,
    "deciles": "SELECT feature, target, month, decile, count(*) AS n_obs, avg(y) AS mean_return, median(y) AS median_return FROM (SELECT *, ntile(10) OVER (PARTITION BY feature, target, month ORDER BY x, permno) AS decile FROM long) GROUP BY ALL HAVING count(*) >= 5",
    "spreads": "SELECT feature, target, month, max(CASE WHEN decile = 10 THEN mean_return END) - max(CASE WHEN decile = 1 THEN mean_return END) AS high_minus_low FROM deciles GROUP BY ALL",
    "ic": f"SELECT feature, target, month, count(*) AS n_obs, {corr('rx', 'ry')} AS rank_ic FROM (SELECT *, percent_rank() OVER (PARTITION BY feature, target, month ORDER BY x) AS rx, percent_rank() OVER (PARTITION BY feature, target, month ORDER BY y) AS ry FROM long) GROUP BY ALL HAVING count(*) >= 50",
    "uni": "SELECT *, 1 - (1 - r2) * (n_obs - 1) / greatest(n_obs - 2, 1) AS adj_r2 FROM (SELECT feature, target, month, count(*) AS n_obs, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM long GROUP BY ALL HAVING count(*) >= 50 AND var_pop(x) > 0)",
    "predictions": " UNION ALL ".join(f"SELECT '{m}' AS model, '{t}' AS target, month, permno, -{c} AS prediction, {t} AS actual_return FROM panel WHERE {t} IS NOT NULL" for m, c in (("all", "owner_hhi"), ("no_network", "fragility_proxy")) for t in TARGETS),
    "placed": "SELECT *, row_number() OVER (PARTITION BY model, target, month ORDER BY prediction, permno) / count(*) OVER (PARTITION BY model, target, month) AS share FROM predictions",
    "sided": "SELECT *, CASE WHEN share >= 0.9 THEN 1 WHEN share <= 0.1 THEN -1 ELSE 0 END AS side FROM placed",
    "book": "SELECT model, target, month, permno, side, prediction, actual_return, count(*) OVER (PARTITION BY model, target, month, side) AS n_side, 0.5 * side / count(*) OVER (PARTITION BY model, target, month, side) AS weight FROM sided WHERE side <> 0",
    "folio": "SELECT *, long_leg_mean_return - short_leg_mean_return AS academic_spread_return FROM (SELECT model, target, month, sum(weight * actual_return) AS gross_dollar_neutral_return, avg(CASE WHEN side = -1 THEN actual_return END) AS short_leg_mean_return, avg(CASE WHEN side = 1 THEN actual_return END) AS long_leg_mean_return, count(*) FILTER (side = -1) AS n_short, count(*) FILTER (side = 1) AS n_long FROM book GROUP BY ALL)",
    "ticks": "SELECT model, target, month, row_number() OVER (PARTITION BY model, target ORDER BY month) AS t FROM (SELECT DISTINCT model, target, month FROM book)",
    "timed": "SELECT model, target, permno, t, weight AS w FROM book JOIN ticks USING (model, target, month)",
    "moves": "SELECT coalesce(a.model, b.model) AS model, coalesce(a.target, b.target) AS target, coalesce(a.t, b.t) AS t, a.w, b.w AS w0 FROM timed a FULL JOIN (SELECT * REPLACE (t + 1 AS t) FROM timed) b ON a.model = b.model AND a.target = b.target AND a.permno = b.permno AND a.t = b.t",
    "turn": "SELECT model, target, month, turnover_abs_change, turnover_abs_change / 2 AS turnover_one_way, gross_exposure, net_exposure, n_names FROM ticks JOIN (SELECT model, target, t, sum(abs(coalesce(w, 0) - coalesce(w0, 0))) AS turnover_abs_change, sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure, count(w) AS n_names FROM moves GROUP BY ALL) USING (model, target, t)",
    "costed": "SELECT *, " + ", ".join(f"gross_dollar_neutral_return - {b} / 10000.0::DOUBLE * turnover_abs_change AS net_return_{b}bps" for b in COST_BPS) + " FROM folio LEFT JOIN turn USING (model, target, month)",
    "series": " UNION ALL ".join(f"SELECT model, target, month, turnover_abs_change, turnover_one_way, n_long, n_short, '{c}' AS return_series, {c} AS r FROM costed" for c in ["gross_dollar_neutral_return", *(f"net_return_{b}bps" for b in COST_BPS)]),
    "wealthy": "SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY model, target, return_series ORDER BY month) AS wealth FROM series",
    "peaked": "SELECT *, max(wealth) OVER (PARTITION BY model, target, return_series ORDER BY month) AS top, arg_max(month, wealth) OVER (PARTITION BY model, target, return_series ORDER BY month) AS peak_month FROM wealthy",
    "falls": "SELECT model, target, return_series, min(wealth / top - 1) AS max_drawdown, arg_min(peak_month, wealth / top - 1 ORDER BY month) AS peak, arg_min(month, wealth / top - 1 ORDER BY month) AS trough FROM peaked GROUP BY ALL",
    "perf0": f"SELECT a.*, b.mean AS mean_period_return, b.t AS nw_t_mean, {ann()} * b.mean AS annualized_mean_return, sqrt({ann()}) * b.std AS annualized_volatility, f.max_drawdown, f.peak AS max_drawdown_peak_month, f.trough AS max_drawdown_trough_month FROM (SELECT model, target, return_series, count(*) AS months, avg((r > 0)::INTEGER) AS hit_rate, product(1 + r) - 1 AS cumulative_return, avg(turnover_abs_change) AS avg_turnover_abs_change, avg(turnover_one_way) AS avg_turnover_one_way, avg(n_long) AS avg_n_long, avg(n_short) AS avg_n_short FROM series GROUP BY ALL) a JOIN {newey_west('series', 'model, target, return_series', 'month', 'r')} b USING (model, target, return_series) JOIN falls f USING (model, target, return_series)",
    "perf": "SELECT *, CASE WHEN annualized_volatility > 0 THEN annualized_mean_return / annualized_volatility END AS sharpe_approx FROM perf0",
    "compared": "SELECT *, rank() OVER (PARTITION BY target ORDER BY sharpe_approx DESC NULLS LAST) AS rank_by_sharpe_within_target FROM perf WHERE return_series = 'net_return_25bps'",
}


def taken_out(out: dict[str, str], prefix: str, rows: str, by: str, columns: list[str]) -> str:
    """Adds expressions to ``out`` that take each of ``columns`` out of those after it, group by group; the last one's name."""
    w = f"OVER (PARTITION BY {by})"
    for i, v in enumerate(columns[:-1]):
        rest = ", ".join(f"{c} - sum({v} * {c}) {w} / sum({v} * {v}) {w} * {v} AS {c}" for c in columns[i + 1 :])
        out[f"{prefix}{i}"] = f"SELECT * REPLACE ({rest}) FROM {rows}"
        rows = f"{prefix}{i}"
    return rows


def _regression_rows(source: str, by: str, kept: str, y: str, xs: list[str], least: int) -> str:
    """Complete rows with y, y0 (y again), x0 = 1, x1, ... of groups with ``least`` of them, and their number n."""
    named = ", ".join(f"{x}::DOUBLE AS x{i}" for i, x in enumerate(xs, 1))
    return f"SELECT * FROM (SELECT {kept}, {y}::DOUBLE AS y, {y}::DOUBLE AS y0, 1.0::DOUBLE AS x0, {named}, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [y, *xs])}) WHERE n >= {least}"


_R2 = "1 - sum(y * y) / nullif(sum(y0 * y0) - sum(y0) * sum(y0) / count(*), 0)"


def ols(name: str, source: str, by: str, y: str, xs: list[str], least: int) -> dict[str, str]:
    """Expressions that end in ``name`` with by, n_obs, r2, adj_r2, variable, coef: least squares of y on xs and a constant in each group."""
    names = [f"x{i}" for i in range(len(xs) + 1)]
    out = {f"{name}_rows": _regression_rows(source, by, by, y, xs, least)}
    fit = taken_out(out, f"{name}_e", f"{name}_rows", by, [*names, "y"])
    out[f"{name}_fit"] = f"SELECT {by}, any_value(n) AS n_obs, {_R2} AS r2 FROM {fit} GROUP BY {by}"
    parts = []
    for x, label in zip(names, ["const", *xs]):
        left = taken_out(out, f"{name}_{x}_", f"{name}_rows", by, [*(c for c in names if c != x), x])
        parts.append(f"SELECT {by}, '{label}' AS variable, sum({x} * y0) / sum({x} * {x}) AS coef FROM {left} GROUP BY {by}")
    out[f"{name}_all"] = " UNION ALL ".join(parts)
    out[name] = f"SELECT a.*, n_obs, r2, 1 - (1 - r2) * (n_obs - 1) / greatest(n_obs - {len(names)}, 1) AS adj_r2 FROM {name}_all a JOIN {name}_fit USING ({by})"
    return out


def hac(name: str, source: str, by: str, order: str, y: str, xs: list[str], lags: int = 6, least: int = 36) -> dict[str, str]:
    """Expressions that end in ``name`` with by, n, r2, variable, coef, t: least squares of y on xs and a constant, with HAC errors.

    Each coefficient is that of y on what is left of its regressor after the others are taken out one by one; the products of that with the
    residuals have the coefficient's HAC variance.
    """
    names = [f"x{i}" for i in range(len(xs) + 1)]
    out = {f"{name}_rows": _regression_rows(source, by, f"{by}, {order}", y, xs, least)}
    fit = taken_out(out, f"{name}_e", f"{name}_rows", by, [*names, "y"])
    out[f"{name}_fit"] = f"SELECT {by}, {_R2} AS r2 FROM {fit} GROUP BY {by}"
    parts = []
    for x, label in zip(names, ["const", *xs]):
        left = taken_out(out, f"{name}_{x}_", f"{name}_rows", by, [*(c for c in names if c != x), x])
        u = f"SELECT {by}, {order}, n, y0, r, r * y AS u FROM (SELECT {by}, {order}, n, y0, {x} AS r FROM {left}) JOIN (SELECT {by}, {order}, y FROM {fit}) USING ({by}, {order})"
        lagged = f"SELECT *, {', '.join(f'lag(u, {m}) OVER (PARTITION BY {by} ORDER BY {order}) AS u{m}' for m in range(1, lags + 1))} FROM ({u})"
        var = "sum(u * u) + " + " + ".join(f"2 * (1 - {m} / {lags + 1}.0::DOUBLE) * coalesce(sum(u * u{m}), 0)" for m in range(1, lags + 1))
        parts.append(f"SELECT {by}, any_value(n) AS n, '{label}' AS variable, sum(r * y0) / sum(r * r) AS coef, sum(r * y0) / nullif(sqrt(greatest({var}, 0)), 0) AS t FROM ({lagged}) GROUP BY {by}")
    out[f"{name}_all"] = " UNION ALL ".join(parts)
    out[name] = f"SELECT a.*, r2 FROM {name}_all a JOIN {name}_fit USING ({by})"
    return out


def strata(column: str) -> str:
    return f"SELECT month, permno, CASE WHEN v IS NULL THEN 'missing' WHEN share <= 1.0::DOUBLE / 3 THEN 'low' WHEN share > 2.0::DOUBLE / 3 THEN 'high' ELSE 'mid' END AS stratum FROM (SELECT month, permno, {column} AS v, row_number() OVER (PARTITION BY month, {column} IS NULL ORDER BY {column}, permno) / count(*) OVER (PARTITION BY month, {column} IS NULL) AS share FROM panel)"


def metrics(source: str, by: str, least: int) -> str:
    cell = f"{by}, month"
    ranks = f"SELECT *, rank() OVER (PARTITION BY {cell} ORDER BY p) + (count(*) OVER (PARTITION BY {cell}, p) - 1) / 2 AS rp, rank() OVER (PARTITION BY {cell} ORDER BY y) + (count(*) OVER (PARTITION BY {cell}, y) - 1) / 2 AS ry, row_number() OVER (PARTITION BY {cell} ORDER BY p, permno) / count(*) OVER (PARTITION BY {cell}) AS share FROM (SELECT {cell}, permno, prediction AS p, actual_return AS y FROM {source})"
    cells = f"(SELECT {cell}, count(*) AS n, {corr('rp', 'ry')} AS rank_ic, avg(CASE WHEN share >= 0.9 THEN y END) - avg(CASE WHEN share <= 0.1 THEN y END) AS spread, avg(((p > 0) = (y > 0))::INTEGER) AS hit, count(*) FILTER (share >= 0.9) AS top, count(*) FILTER (share <= 0.1) AS bottom FROM ({ranks}) GROUP BY ALL HAVING count(*) >= {least})"
    nw = lambda v: newey_west(cells, by, "month", v)
    return f"""SELECT {by}, a.nrows::BIGINT AS "rows", coalesce(c.months, 0)::BIGINT AS months, {r('c.tn', 'avg_top_names')}, {r('c.bn', 'avg_bottom_names')}, {r('i.mean', 'rank_ic_mean')}, {r('i.t', 'rank_ic_t_hac6')}, {r('s.mean', 'spread_mean')}, {r('s.t', 'spread_t_hac6')}, {r('h.mean', 'hit_rate_mean')}, {r('h.t', 'hit_rate_t_hac6')}, {r(f's.mean * {ann()}', 'annualized_spread_approx')}, {r(f'CASE WHEN s.n > 2 AND s.std > 0 THEN s.mean / s.std * sqrt({ann()}) END', 'annualized_spread_to_vol_proxy')}
      FROM (SELECT {by}, count(*) AS nrows FROM {source} GROUP BY ALL) a LEFT JOIN (SELECT {by}, count(*) AS months, avg(CASE WHEN spread IS NOT NULL THEN top ELSE 0 END) AS tn, avg(CASE WHEN spread IS NOT NULL THEN bottom ELSE 0 END) AS bn FROM {cells} GROUP BY ALL) c USING ({by})
      LEFT JOIN {nw('rank_ic')} i USING ({by}) LEFT JOIN {nw('spread')} s USING ({by}) LEFT JOIN {nw('hit')} h USING ({by})"""


def with_ctes(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` after the expressions that it needs."""
    known = CTES | (extra or {})
    needed: list[str] = []

    def visit(sql: str):
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", sql)):
            if name in known and name not in needed:
                visit(known[name])
                needed.append(name)

    visit(query)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed) + " " if needed else "") + query
