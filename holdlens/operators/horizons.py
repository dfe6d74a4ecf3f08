"""Forward returns over trading days, and up to the end of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdlens.functions.columns import finite, month_floor, month_text, require_columns

#: Trading days ahead.
HORIZONS = (21, 63)


def trading_days(daily: DataFrame) -> DataFrame:
    """``(date, day_index)``: the dates on which any security has a row, from 0 on; one row a day of the calendar."""
    days = require_columns(daily, ["date"]).where("date is not null").agg(F.sort_array(F.collect_set("date")).alias("days"))
    return days.select(F.posexplode("days").alias("day_index", "date")).select("date", "day_index")


def daily_forward_returns(daily: DataFrame, *, horizons: tuple[int, ...] = HORIZONS, least: int = 1) -> DataFrame:
    """``daily(permno, date, ret)`` with ``day_index`` and ``fwd_ret_<h>d`` for each horizon.

    Returns of the ``h`` trading days after a row's own are compounded; days without a row of the security, or with a return that is no
    number, earn nothing. Null where fewer than ``least`` of them have a return, or the calendar ends before. Rows that repeat a security and a
    date must not occur; rows without either are left out. Each row reads up to h rows after it.
    """
    rows = require_columns(daily, ["permno", "date", "ret"]).where("permno is not null").join(F.broadcast(trading_days(daily)), "date")  # a row a day
    rows = rows.withColumn("last_index", F.lit(trading_days(daily).agg(F.max("day_index")).scalar()))
    own = Window.partitionBy("permno").orderBy("day_index")
    ret = finite(F.col("ret"))
    for h in horizons:
        ahead = own.rangeBetween(1, h)
        told = (F.count(ret).over(ahead) >= least) & (F.col("day_index") + h <= F.col("last_index"))
        rows = rows.withColumn(f"fwd_ret_{h}d", F.when(told, F.product(1 + ret).over(ahead) - 1))
    return rows.drop("last_index")


def month_end_horizons(forward: DataFrame, *, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """``(month, permno, fwd_ret_<h>d ...)`` of each security's last row of a month, so that what a month's end knows meets later days alone."""
    last = [F.max_by(f"fwd_ret_{h}d", "day_index").alias(f"fwd_ret_{h}d") for h in horizons]
    return forward.groupBy(month_text(F.col("date")).alias("month"), "permno").agg(*last)


def with_delistings(monthly: DataFrame, delistings: DataFrame, *, missing: float | None = None) -> DataFrame:
    """``monthly`` with the terminal returns of ``delistings(permno, date, dlret)``, and ``delisted``: true on a listing's last row.

    An event in the month of the security's last row is compounded into that row's return (alone where it has none); a later one adds a row of its own,
    with the event's date, month and return and no price. An event before the last row's month ends nothing and is ignored, and so is one of a security without rows. Of
    several events of a security the latest counts, of equal dates the lowest return. A return that is unknown is ``missing``; where that is null
    too, the listing ends with the return it had. Columns other than those named are null in added rows, but for ``permco``, which stays.
    """
    require_columns(monthly, ["permno", "date", "month_date", "month", "ret"])
    d = require_columns(delistings, ["permno", "date", "dlret"]).where("permno is not null and date is not null")
    d = d.select("permno", F.col("date").cast("date").alias("date"), F.coalesce(finite(F.col("dlret")), F.lit(missing).cast("double")).alias("dlret"))
    d = d.groupBy("permno").agg(F.min_by(F.struct("date", "dlret"), F.struct((-F.unix_date("date")).alias("late"), F.coalesce("dlret", F.lit(float("inf"))).alias("low"))).alias("event"))
    # events and last rows meet by permno, where the window has put the rows already
    latest = F.max("month_date").over(Window.partitionBy("permno"))
    rows = monthly.withColumn("last_month", latest).join(d, "permno", "left")
    event = month_floor(F.col("event.date"))
    final = F.col("month_date") == F.col("last_month")
    here, later = F.coalesce(final & (event == F.col("last_month")), F.lit(False)), F.coalesce(final & (event > F.col("last_month")), F.lit(False))
    dlret = F.col("event.dlret")
    stitched = F.when(here & dlret.isNotNull(), (1 + F.coalesce("ret", F.lit(0.0))) * (1 + dlret) - 1).otherwise(F.col("ret"))
    new = {"permno": F.col("permno"), "permco": F.col("permco") if "permco" in monthly.columns else None, "date": F.col("event.date"), "month_date": event, "month": month_text(event), "ret": dlret}
    kinds = {f.name: f.dataType for f in monthly.schema.fields}
    own = F.struct(*((stitched if c == "ret" else F.col(c)).cast(kinds[c]).alias(c) for c in monthly.columns), here.alias("delisted"))
    added = F.struct(*(new.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in monthly.columns), F.lit(True).alias("delisted"))
    return rows.select(F.explode(F.when(later, F.array(own, added)).otherwise(F.array(own))).alias("row")).select("row.*")


def forward_to_the_end(monthly: DataFrame, *, legs: int = 3) -> DataFrame:
    """``with_delistings`` rows with ``fwd_ret_1m`` and ``fwd_ret_<legs>m``: rows ahead, compounded, up to the end of a delisted listing.

    After a terminal return nothing more is earned, so a window that reaches past the end has the returns up to it; the last row itself has no return
    ahead. Listings that the table merely stops at stay null there. A null return ahead makes its window null.
    """
    w = Window.partitionBy("permno").orderBy("date")
    ended = F.max("delisted").over(Window.partitionBy("permno"))

    def ahead(k: int) -> Column:
        leg = F.lead("ret", k).over(w)
        return leg if k == 1 else F.when(F.lead("permno", k).over(w).isNull() & ended, F.lit(0.0)).otherwise(leg)

    growth = F.lit(1.0)
    for k in range(1, legs + 1):
        growth = growth * (1 + ahead(k))
    return monthly.withColumns({"fwd_ret_1m": ahead(1), f"fwd_ret_{legs}m": growth - 1})
