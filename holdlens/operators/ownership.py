"""Point-in-time ownership: from raw disclosures to stock-month features.

A position is visible from the month in which its filing became public, and is carried
on until the manager's next filing, six months at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import cusip8, month_floor, month_text, parse_date, parse_number, position_value, quarter_label, resolve, safe_ratio
from holdlens.functions.intervals import interval_index
from holdlens.sources.shared import spread, written

HOLDING_ALIASES = {
    "manager_id": ["manager_id", "mgrno", "cik"],
    "cusip": ["cusip8", "cusip", "ncusip"],
    "report_date": ["report_date", "rdate"],
    "filing_date": ["filing_date", "fdate"],
    "shares": ["shares", "sshprnamt"],
    "reported_value": ["reported_value", "value"],
}
NAME_ALIASES = {
    "permno": ["permno"], "cusip": ["cusip8", "ncusip", "cusip"], "permco": ["permco"], "name_start": ["name_start", "namedt"], "name_end": ["name_end", "nameendt"],
    "shrcd": ["shrcd"], "exchcd": ["exchcd"], "ticker": ["ticker"], "comnam": ["comnam"],
}
MONTHLY_ALIASES = {n: [n] for n in ("permno", "date", "permco", "ret", "retx", "prc", "shrout", "vol", "shrcd", "exchcd")}
COMMON_SHARE_CODES = (10, 11)
FILING_DELAY_DAYS = 45
#: Months after its first that a filing stays active without a successor.
EXPIRY_MONTHS = 5
LAG_KEYS = ["manager_id", "permno"]
BOOK = ["manager_id", "month_date"]
PRICES = ["ret", "retx", "prc", "shrout", "vol", "mktcap_proxy", "fwd_ret_1m", "fwd_ret_3m"]


def _typed(df: DataFrame, parse, names: tuple[str, ...]) -> dict[str, Column]:
    return {n: parse(F.col(n), df.schema[n].dataType) for n in names}


def clean_holdings(raw: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each manager, security and filing, available between ``start`` and ``end``; shares and values are summed.

    Without a filing date a report is public 45 days after its date; without a report date the filing's counts.
    """
    r = resolve(raw, HOLDING_ALIASES, required=("manager_id", "cusip"), defaults={"shares": F.lit(1.0), "reported_value": F.lit(None).cast("double")})
    r = r.withColumns(_typed(r, parse_date, ("report_date", "filing_date")) | _typed(r, parse_number, ("shares", "reported_value")))
    available = F.coalesce("filing_date", F.date_add("report_date", FILING_DELAY_DAYS))
    r = r.withColumn("manager_id", F.col("manager_id").cast("string")).where(available.between(start, end) & (F.coalesce("shares", F.lit(0.0)) > 0))
    # cleaned where it is read: a list of all codes would take one more pass over the rows; by explode, since a filter would clean each code again
    r = r.withColumn("code", cusip8(F.col("cusip"))).select("manager_id", "report_date", "filing_date", "shares", "reported_value", F.explode(F.array_compact(F.array("code"))).alias("cusip8"))
    # a manager stays together from here on: the groups here and in snapshot, and the windows up to the books, fit that
    # a row is held for some months, and each of these is kept by several windows: it counts as ten
    r = spread(r.where("manager_id is not null"), "manager_id", rows=10 * raw.count()).select("manager_id", "cusip8", "report_date", "filing_date", "shares", "reported_value")
    # all other columns follow from these four, so they are made for groups, not for rows
    keys = ["manager_id", "cusip8", "report_date", "filing_date"]
    out = r.groupBy(*keys).agg(F.sum("shares").alias("shares"), F.coalesce(F.sum("reported_value"), F.lit(0.0)).alias("reported_value"))
    out = out.withColumn("available_date", available)
    return out.select(
        *keys, "available_date", F.coalesce("report_date", "available_date").alias("mapping_date"), month_floor(F.col("available_date")).alias("available_month"),
        quarter_label(F.col("report_date")).alias("report_quarter"), F.datediff("available_date", "report_date").alias("filing_lag_days"), "shares", "reported_value",
    )


def with_holding_id(holdings: DataFrame) -> DataFrame:
    """A 64-bit hash of the four keys of ``clean_holdings`` as ``holding_id``."""
    return holdings.withColumn("holding_id", F.xxhash64("manager_id", "cusip8", "report_date", "filing_date"))


def clean_names(raw: DataFrame) -> DataFrame:
    """Distinct validity intervals of security names; an open side is 1900-01-01 or 2099-12-31.

    Where no row has a share code, all are common.
    """
    r = resolve(raw, NAME_ALIASES, required=("permno", "cusip"))
    r = r.withColumns(_typed(r, parse_date, ("name_start", "name_end")) | {n: F.col(n).try_cast("long") for n in ("permno", "permco")} | {n: F.col(n).try_cast("int") for n in ("shrcd", "exchcd")})
    r = r.withColumns({"cusip8": cusip8(F.col("cusip")), "name_start": F.coalesce("name_start", F.to_date(F.lit("1900-01-01"))), "name_end": F.coalesce("name_end", F.to_date(F.lit("2099-12-31")))})
    r = r.na.drop(subset=["permno", "cusip8"]).select("permno", "cusip8", "permco", "name_start", "name_end", "shrcd", "exchcd", F.col("ticker").cast("string"), F.col("comnam").cast("string")).distinct()
    known = r.select("shrcd").where("shrcd is not null").limit(1).isEmpty()
    return r.withColumn("is_common_stock", F.lit(True) if known else F.coalesce(F.col("shrcd").isin(*COMMON_SHARE_CODES), F.lit(False)))


def clean_monthly(raw: DataFrame) -> DataFrame:
    """The last row of each security and month, with market value."""
    r = resolve(raw, MONTHLY_ALIASES, required=("permno", "date", "ret"))
    r = r.withColumns(_typed(r, parse_date, ("date",)) | _typed(r, parse_number, ("ret", "retx", "prc", "shrout", "vol")) | {n: F.col(n).try_cast("long") for n in ("permno", "permco")} | {n: F.col(n).try_cast("int") for n in ("shrcd", "exchcd")})
    r = r.na.drop(subset=["permno", "date"]).withColumns({"month_date": month_floor(F.col("date")), "month": month_text(F.col("date")), "mktcap_proxy": F.abs("prc") * F.col("shrout")})
    last = Window.partitionBy("permno", "month_date").orderBy(F.col("date").desc(), F.col("prc").desc_nulls_last(), F.col("ret").desc_nulls_last())
    return r.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def forward_returns(monthly: DataFrame, *, calendar_strict: bool = False) -> DataFrame:
    """The next row's return, and the product of the next three; gaps are skipped unless ``calendar_strict``."""
    w = Window.partitionBy("permno").orderBy("date")

    def ahead(k: int) -> Column:
        r = F.lead("ret", k).over(w)
        return F.when(F.lead("month_date", k).over(w) == F.add_months("month_date", k), r) if calendar_strict else r

    return monthly.withColumns({"fwd_ret_1m": ahead(1), "fwd_ret_3m": (1 + ahead(1)) * (1 + ahead(2)) * (1 + ahead(3)) - 1})


def name_index(names: DataFrame) -> DataFrame:
    """The best name of each security number in each piece of time: common stock first, then the latest start, the earliest end, the smallest permno."""
    n = names.select("cusip8", "permno", "permco", "shrcd", "exchcd", "ticker", "comnam", "is_common_stock", "name_start", "name_end")
    order = [-F.coalesce(F.col("is_common_stock").cast("int"), F.lit(-1)), -F.unix_date("name_start"), F.col("name_end"), F.col("permno")]
    return interval_index(n, "cusip8", "name_start", "name_end", order)


def map_point_in_time(holdings: DataFrame, names: DataFrame) -> DataFrame:
    """Each holding with the best name valid at its mapping date, common stock first; then common stock alone.

    A holding meets one piece of the name index, so holdings are neither multiplied nor ranked. The index is a table whose size is known:
    if it is small it is broadcast, and holdings stay where they are.
    """
    pieces = written(name_index(names).where("coalesce(is_common_stock, true)"), "name-index")
    return holdings.join(pieces, "cusip8").where(F.col("mapping_date").between(F.col("piece_start"), F.col("piece_end"))).drop("piece_start", "piece_end")


def snapshot(mapped: DataFrame) -> DataFrame:
    """One row for each manager, security and filing, whatever the number of its cusips."""
    return mapped.groupBy("manager_id", "permno", "report_date", "available_date", "available_month", "mapping_date").agg(
        F.max("permco").alias("permco"), quarter_label(F.col("report_date")).alias("report_quarter"), F.sum("shares").alias("shares"), F.sum("reported_value").alias("reported_value"), F.avg("filing_lag_days").alias("filing_lag_days")
    )


def filing_windows(snap: DataFrame, end: str, *, expiry: int = EXPIRY_MONTHS, supersede_same_month: bool = False) -> DataFrame:
    """First and last month of each manager's filings.

    A filing ends in the month before the next one's first, if that is later, else ``expiry`` months after its own first. So
    of two in a month the earlier one lives on, unless ``supersede_same_month``.
    """
    f = snap.where(F.col("available_month") <= F.lit(end).cast("date")).select("manager_id", "report_date", "available_date", F.col("available_month").alias("active_start_month")).distinct()
    w = Window.partitionBy("manager_id").orderBy("active_start_month", "available_date", F.col("report_date").asc_nulls_last())
    f = f.withColumn("following", F.lead("active_start_month").over(w))
    if supersede_same_month:
        f = f.where(_lasts())
    return f.select("manager_id", "report_date", "available_date", "active_start_month", _until(expiry).alias("active_end_month"))


def _lasts() -> Column:
    """No other filing of the month comes after it."""
    return F.col("following").isNull() | (F.col("following") > F.col("active_start_month"))


def _until(expiry: int) -> Column:
    return F.when(F.col("following") > F.col("active_start_month"), F.add_months("following", -1)).otherwise(F.add_months("active_start_month", expiry))


def expand_positions(snap: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each month in which a position is held; the latest available filing wins."""
    w = windows.select(*(F.col(c).alias(f"w_{c}") for c in ("manager_id", "report_date", "available_date")), "active_start_month", "active_end_month")
    joined = snap.join(w, (F.col("manager_id") == F.col("w_manager_id")) & F.col("report_date").eqNullSafe(F.col("w_report_date")) & F.col("available_date").eqNullSafe(F.col("w_available_date")))
    months = _by_month(joined, snap.columns)
    # placed by manager and month once: the windows here and in value_and_weight both fit that
    return _dated(_latest(months.repartition("month_date", "manager_id")))


def expand_filings(snap: DataFrame, end: str, *, expiry: int = EXPIRY_MONTHS, supersede_same_month: bool = False) -> DataFrame:
    """As ``expand_positions`` with ``filing_windows``, by windows over a manager's rows: where a manager is in one place already, nothing is moved or joined."""
    return _dated(_latest(filing_months(snap, end, expiry=expiry, supersede_same_month=supersede_same_month)))


def filing_months(snap: DataFrame, end: str, *, expiry: int = EXPIRY_MONTHS, supersede_same_month: bool = False) -> DataFrame:
    """A row for each month of each filing's positions, also where several filings have the same one."""
    filing = Window.partitionBy("manager_id").orderBy("available_month", "available_date", F.col("report_date").asc_nulls_last())
    f = snap.where((F.col("available_month") <= F.lit(end).cast("date")) & F.col("manager_id").isNotNull()).withColumn("filing", F.dense_rank().over(filing))
    after = Window.partitionBy("manager_id").orderBy("filing").rangeBetween(1, 1)
    f = f.withColumns({"following": F.first("available_month").over(after), "active_start_month": F.col("available_month")})
    if supersede_same_month:
        f = f.where(_lasts())
    f = f.withColumn("active_end_month", _until(expiry))
    return _by_month(f, snap.columns)


def _by_month(filed: DataFrame, columns: list[str]) -> DataFrame:
    number = lambda c: 12 * F.year(c) + F.month(c)
    later = F.sequence(F.lit(0), number("active_end_month") - number("active_start_month"))
    return filed.withColumn("later", F.explode(later)).select(F.add_months("active_start_month", F.col("later")).alias("month_date"), *columns)


def _latest(months: DataFrame, keys: list[str] = LAG_KEYS) -> DataFrame:
    w = Window.partitionBy(*keys, "month_date").orderBy(F.col("available_date").desc(), F.col("report_date").desc_nulls_last())
    return months.withColumn("rn", F.row_number().over(w)).where("rn = 1")


def _dated(kept: DataFrame) -> DataFrame:
    return kept.select("month_date", month_text(F.col("month_date")).alias("month"), "manager_id", "permno", "permco", "report_date", "available_date", "report_quarter", "shares", "reported_value", "filing_lag_days")


def value_and_weight(positions: DataFrame, monthly: DataFrame, *, price_floor: float | None = None) -> DataFrame:
    """Positions of positive value with prices, forward returns and the weight in their manager's month."""
    return _weigh(_value(positions, monthly, price_floor))


def _value(positions: DataFrame, monthly: DataFrame, price_floor: float | None = None) -> DataFrame:
    v = positions.join(monthly.select("permno", "month_date", *PRICES), ["permno", "month_date"], "left").withColumn("position_value_proxy", position_value(F.col("reported_value"), F.col("shares"), F.col("prc"))).where("position_value_proxy > 0")
    return v if price_floor is None else v.where(F.abs("prc") >= price_floor)


def _weigh(valued: DataFrame) -> DataFrame:
    v = valued.withColumn("manager_total_value_proxy", F.sum("position_value_proxy").over(Window.partitionBy(*BOOK))).where("manager_total_value_proxy > 0")
    return v.withColumns({"portfolio_weight": _weight(), "year": F.year("month_date")})


def _weight() -> Column:
    return safe_ratio(F.col("position_value_proxy"), F.col("manager_total_value_proxy"))


def _sales(valued: DataFrame, keys: list[str] = LAG_KEYS) -> DataFrame:
    """The position's value in the manager's last row of the stock, and what was sold since."""
    before = F.lag("position_value_proxy").over(Window.partitionBy(*keys).orderBy("month_date"))
    p = valued.withColumn("lag_position_value_proxy", before)
    return p.withColumn("sell_amount_proxy", F.greatest(F.coalesce("lag_position_value_proxy", "position_value_proxy") - F.col("position_value_proxy"), F.lit(0.0)))


def _books(weighted: DataFrame) -> DataFrame:
    """Breadth and concentration of the manager's month; a stock occurs once in it, so its rows are its breadth."""
    book = Window.partitionBy(*BOOK)
    return weighted.withColumns({"manager_breadth": F.count("permno").over(book), "manager_concentration": F.sum(F.col("portfolio_weight") * F.col("portfolio_weight")).over(book)})


#: What ``books`` leaves out, since ``with_prices`` has it from other columns.
_DERIVED = [*PRICES, "portfolio_weight", "year", "report_quarter"]


def books(expanded: DataFrame, monthly: DataFrame) -> DataFrame:
    """All that a manager's rows say of each position, without prices: for a table that ``with_prices`` and ``weights`` read.

    Value, book total, breadth, concentration and sales in one go, by windows over a manager's rows alone.
    """
    return _books(_weigh(_sales(_value(expanded, monthly)))).drop(*_DERIVED)


def valued(expanded: DataFrame, monthly: DataFrame) -> DataFrame:
    """Positions of positive value, without prices; what ``weighed`` makes of them is enough for ``with_prices``, and has no breadth, concentration and sales."""
    return _value(expanded, monthly).drop(*PRICES, "report_quarter")


def weighed(positions: DataFrame) -> DataFrame:
    """Positions with the total of their manager's month, where that is above 0."""
    return _weigh(positions).drop("portfolio_weight", "year")


#: Fields of ``held`` in ``folios``, beside the stock's number.
HELD = ["permco", "position_value_proxy", "sell_amount_proxy"]


def stock_numbers(names: DataFrame) -> DataFrame:
    """``(permno, n)``: the securities of ``names`` in the order of permno, from 0."""
    return names.select("permno").distinct().withColumn("n", (F.row_number().over(Window.orderBy("permno")) - 1).cast("int"))


#: Words of 64 stocks that a book's row has at most; with more securities ``network.network_degree`` makes them.
FOLIO_WORDS = 32


def folios(snap: DataFrame, monthly: DataFrame, numbers: DataFrame, end: str) -> DataFrame:
    """What ``books`` says of ``expand_filings``, as far as stocks and their network need it, in one row for each manager and month; its positions are the array ``held``.

    ``held`` has ``n`` of ``numbers`` and ``HELD``. ``words`` are the bits of the stocks whose weight is above 0 (null with more than ``FOLIO_WORDS``), ``some`` their
    numbers where these aren't all. Whoever sums up a book reads its row, so nothing is moved for that.
    """
    keys = ["place", *LAG_KEYS]  # a number before the keys: sorts compare it first, and it tells almost all of them apart
    kept = _latest(filing_months(snap.withColumn("place", F.xxhash64(*LAG_KEYS)), end), keys)
    priced = kept.join(monthly.select("permno", "month_date", "prc"), ["permno", "month_date"], "left").join(numbers, "permno")
    value, n = F.col("position_value_proxy"), F.col("n")
    v = priced.withColumn("position_value_proxy", position_value(F.col("reported_value"), F.col("shares"), F.col("prc"))).where("position_value_proxy > 0")
    v = _sales(v.select(*keys, "month_date", "permco", "n", value), keys).drop("lag_position_value_proxy")
    last = -(-numbers.count() // 64)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))
    words = [F.bit_or(F.when(F.shiftright(n, 6) == k, bit(n)).otherwise(0)).alias(f"w{k}") for k in range(last)] if last <= FOLIO_WORDS else []
    total = F.col("manager_total_value_proxy")
    f = v.groupBy(F.xxhash64(*BOOK).alias("place"), *BOOK).agg(
        F.sum(value).alias("manager_total_value_proxy"), F.count(F.lit(1)).alias("manager_breadth"), F.sum(value * value).alias("squares"), F.min(value).alias("least"), F.collect_list(F.struct("n", *HELD)).alias("held"), *words
    ).where("manager_total_value_proxy > 0")
    # a weight may be too small for a double
    whole = F.col("least") / total > 0
    some = F.transform(F.filter("held", lambda x: x["position_value_proxy"] / total > 0), lambda x: x["n"])
    bits = lambda k: F.aggregate(some, F.lit(0).cast("long"), lambda a, i: F.when(F.shiftright(i, 6) == k, a.bitwiseOR(bit(i))).otherwise(a))
    made = F.array(*(F.when(whole, F.col(f"w{k}")).otherwise(bits(k)) for k in range(last))) if words else F.lit(None).cast("array<bigint>")
    return f.select("month_date", "manager_id", total, "manager_breadth", safe_ratio(F.col("squares"), total * total).alias("manager_concentration"), "held", F.when(~whole, some).alias("some"), made.alias("words"))


def held_rows(of: DataFrame, numbers: DataFrame) -> DataFrame:
    """The positions of ``folios``, with what ``stock_features`` needs."""
    sums = ["month_date", "manager_breadth", "manager_concentration"]
    return of.select(*sums, F.explode("held").alias("x")).select(*sums, *(F.col(f"x.{c}") for c in ("n", *HELD))).join(numbers, "n")


def with_prices(held: DataFrame, monthly: DataFrame) -> DataFrame:
    """The positions of ``value_and_weight`` with sales, breadth and concentration, from the table of ``books``."""
    p = held.join(monthly.select("permno", "month_date", *PRICES), ["permno", "month_date"], "left")
    return p.withColumns({"portfolio_weight": _weight(), "year": F.year("month_date"), "report_quarter": quarter_label(F.col("report_date"))})


def weights(held: DataFrame) -> DataFrame:
    """``(month_date, month, manager_id, permno, position_value_proxy, portfolio_weight)`` from the table of ``books``."""
    return held.select("month_date", "month", "manager_id", "permno", "position_value_proxy", _weight().alias("portfolio_weight"))


def manager_features(positions: DataFrame) -> DataFrame:
    """Breadth, total value and concentration of each manager and month; a stock occurs once in a manager's month, so its rows are its breadth."""
    return positions.groupBy("month_date", "month", "manager_id").agg(
        F.count("permno").alias("manager_breadth"), F.sum("position_value_proxy").alias("manager_total_value_proxy"), F.sum(F.col("portfolio_weight") * F.col("portfolio_weight")).alias("manager_concentration")
    )


def sell_pressure(positions: DataFrame) -> DataFrame:
    """Positions with manager features, owner shares and the value sold since the manager's last row of the stock.

    A complete exit leaves no row, so it counts nothing; a first row counts 0. Columns that ``books`` has made are taken as they are. The stocks' totals are
    a table whose size is known: if it is small it is broadcast, and positions stay where they are.
    """
    p = positions if "sell_amount_proxy" in positions.columns else _books(_sales(positions))
    totals = written(p.groupBy("month_date", "permno").agg(F.sum("position_value_proxy").alias("stock_total_value_proxy")), "stock-totals")
    p = p.join(totals, ["month_date", "permno"], "left")
    return p.withColumn("stock_owner_share", safe_ratio(F.col("position_value_proxy"), F.col("stock_total_value_proxy")))


def stock_features(enriched: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Ownership features of each stock and month.

    ``monthly``: ``enriched`` is the table of ``books``, or ``held_rows``, whose rows have neither prices nor their share of the stock. Sums of a stock's month give all features,
    and only these rows meet the prices, so no position is joined or moved.
    """
    value = F.col("position_value_proxy")
    total = F.sum(value)
    if monthly is None:
        share = F.col("stock_owner_share")
        hhi, top, prices = F.sum(share * share), F.max(share), [F.max(c).alias(c) for c in PRICES]
    else:
        hhi, top, prices = safe_ratio(F.sum(value * value), total * total), safe_ratio(F.max(value), total), []
    known = "month" in enriched.columns
    out = enriched.groupBy("month_date", *(["month"] if known else []), "permno").agg(
        F.max("permco").alias("permco"), F.count(F.col("manager_id") if known else F.lit(1)).alias("owner_count"), total.alias("total_position_value_proxy"),
        hhi.alias("owner_hhi"), top.alias("top_owner_share"), F.avg("manager_concentration").alias("fragility_proxy"),
        F.avg("manager_breadth").alias("avg_manager_breadth"), safe_ratio(F.sum("sell_amount_proxy"), total).alias("stock_sell_pressure"),
        *prices,
    )
    if not known:
        out = out.select("month_date", month_text(F.col("month_date")).alias("month"), *out.columns[1:])
    if monthly is not None:
        out = out.join(monthly.select("permno", "month_date", *PRICES), ["permno", "month_date"], "left").select("month_date", "month", "permno", *out.columns[3:], *PRICES)
    return out.withColumn("year", F.year("month_date"))


def coverage_by_month(positions: DataFrame) -> DataFrame:
    return positions.groupBy("month").agg(F.count(F.lit(1)).alias("position_rows"), F.count_distinct("permno").alias("stocks"), F.count_distinct("manager_id").alias("managers"), F.avg("portfolio_weight").alias("avg_portfolio_weight"))
