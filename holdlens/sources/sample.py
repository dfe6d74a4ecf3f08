"""Raw holdings, names, prices and factors made from the order tables.

A supplier is a manager, a brand and type is a security, a quarter's deliveries are a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdlens.sources.shared import small

#: First and last day that holdings may become available, and no date of the sample is after the last.
START, END = "1995-01-01", "2002-12-31"


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, permno)``; types are numbered in alphabetical order."""
    part = _table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"])
    types = part.agg(F.sort_array(F.collect_set("p_type"))).scalar()  # a handful of words; no join, so that the size of `part` stays known
    return part.select("p_partkey", (F.expr("int(substring(p_brand, 7))") * 10 + F.array_position(types, F.col("p_type"))).cast("long").alias("permno"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    day = F.col("l_shipdate").cast("date")
    report = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return line.join(small(securities(spark, sf_dir)), F.col("l_partkey") == F.col("p_partkey")).select("permno", "l_suppkey", "l_quantity", "l_extendedprice", day.alias("day"), report.alias("report"))


def raw_holdings(t: DataFrame) -> DataFrame:
    return t.select(
        F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("MGRNO"),
        F.concat(F.lit("c-"), F.lpad(F.col("permno").cast("string"), 7, "0"), F.lit("x9")).alias("cusip"),
        F.col("report").alias("rdate"),
        F.when(F.col("l_suppkey") % 11 != 0, F.date_add("report", (20 + F.col("l_suppkey") % 50).cast("int"))).alias("fdate"),
        F.col("l_quantity").alias("shares"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice")).alias("value"),
    )


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = securities(spark, sf_dir).select("permno").distinct()
    periods = F.array(F.struct(F.lit("1900-01-01").alias("a"), F.lit("1998-06-30").alias("b"), F.lit(10).alias("k")), F.struct(F.lit("1998-07-01").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(11).alias("k")))
    return s.select("permno", F.explode(periods).alias("p")).select(
        "permno", F.concat(F.lit("C"), F.lpad(F.col("permno").cast("string"), 7, "0")).alias("ncusip"), (F.col("permno") * 10).alias("permco"),
        F.col("p.a").alias("namedt"), F.col("p.b").alias("nameendt"), F.when(F.col("permno") % 7 == 0, 31).otherwise(F.col("p.k")).alias("shrcd"),
        (F.col("permno") % 3 + 1).cast("int").alias("exchcd"), F.concat(F.lit("T"), F.col("permno").cast("string")).alias("ticker"), F.concat(F.lit("Company "), F.col("permno").cast("string")).alias("comnam"),
    )


def raw_monthly(t: DataFrame) -> DataFrame:
    m = t.groupBy("permno", F.last_day("day").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("prc"), F.sum("l_quantity").alias("vol"), (F.count(F.lit(1)) * 1000.0).alias("shrout"))
    ret = F.col("prc") / F.lag("prc").over(Window.partitionBy("permno").orderBy("date")) - 1
    return m.select("permno", "date", (F.col("permno") * 10).alias("permco"), ret.alias("ret"), (ret - 0.001).alias("retx"), "prc", "shrout", "vol", F.lit(10).alias("shrcd"), F.lit(1).alias("exchcd"))


def raw_daily(t: DataFrame) -> DataFrame:
    """Mean price of each security and day, and its change since the security's last day."""
    d = t.groupBy("permno", F.col("day").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("prc"))
    return d.withColumn("ret", F.col("prc") / F.lag("prc").over(Window.partitionBy("permno").orderBy("date")) - 1)


def raw_delistings(t: DataFrame) -> DataFrame:
    """A terminal event for some securities: on their last day, 40 days after it or, to be ignored, 70 days before it."""
    last = t.groupBy("permno").agg(F.max("day").alias("day")).where("permno % 3 = 0")
    away = F.element_at(F.array(F.lit(0), F.lit(40), F.lit(-70)), (F.col("permno") % 4 % 3 + 1).cast("int"))
    return last.select("permno", F.date_add("day", away).alias("date"), F.when(F.col("permno") % 5 != 0, (F.col("permno") % 7) / 10 - 0.5).alias("dlret"))
