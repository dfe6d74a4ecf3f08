"""Scans by date window, optional inputs and sinks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdlens.functions.columns import parse_date, require_columns, resolve, role_columns

# Names under which factor tables have their columns.
FACTOR_ALIASES = {
    "date": ["date", "dateff", "mcaldt", "caldt", "month"], "mktrf": ["mktrf", "mkt_rf", "mkt-rf", "mkt"], "smb": ["smb"], "hml": ["hml"],
    "rf": ["rf"], "umd": ["umd", "mom"], "rmw": ["rmw"], "cma": ["cma"],
}


def calendar_windows(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """``(window_start, window_end)``: closed windows of whole months from start's month on, the last cut at ``end``."""
    span = spark.createDataFrame([(date.fromisoformat(start), date.fromisoformat(end))], "a date, b date")
    return span.select("b", F.explode(F.expr(f"sequence(trunc(a, 'MM'), b, interval {int(months)} month)")).alias("window_start")).select(
        "window_start", F.least(F.date_sub(F.add_months("window_start", months), 1), "b").alias("window_end")
    )


def date_predicate(kind: T.DataType, column: str, start: str, end: str, *, compact: bool = False) -> str:
    """A SQL predicate on a closed date window that suits how the source stores dates.

    Numbers are yyyymmdd, text is ISO (a time may follow) or, with ``compact``, yyyymmdd; all else is a date or
    timestamp. The window is half open inside, so a time on the last day is in it and no row falls between two windows.
    """
    after = date.fromisoformat(end) + timedelta(days=1)
    if isinstance(kind, T.NumericType):
        return f"{column} BETWEEN {start.replace('-', '')} AND {end.replace('-', '')}"
    if isinstance(kind, T.StringType):
        a, b = (start.replace("-", ""), f"{after:%Y%m%d}") if compact else (start, after.isoformat())
        return f"{column} >= '{a}' AND {column} < '{b}'"
    return f"{column} >= DATE '{start}' AND {column} < DATE '{after}'"


def read_jdbc_windows(spark: SparkSession, url: str, table: str, columns: list[str], date_column: str, windows: list[tuple[str, str]], kind: T.DataType | None = None, compact: bool = False, properties: dict[str, str] | None = None) -> DataFrame:
    """A JDBC table with a partition for each window; only ``columns`` are fetched."""
    predicates = [date_predicate(kind or T.DateType(), date_column, a, b, compact=compact) for a, b in windows]
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties or {}).select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], properties: dict[str, str] | None = None) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties or {}).select(*columns)


def factor_scan(table: DataFrame, start: str, end: str) -> DataFrame:
    """Date, market and the other factors that ``table`` has, under one name each, of the days in [start, end] (ISO); no other column is read.

    Dates may be dates, times, yyyymmdd numbers or texts; a table whose dates are numbers or texts is filtered after they are parsed. Without a date, a market
    factor and two of smb, hml and rf it raises.
    """
    wanted = table.select(*(F.col(f"`{c}`") for c in role_columns(table.columns, FACTOR_ALIASES)))
    known = {c.lower() for c in wanted.columns}
    found = {n: options for n, options in FACTOR_ALIASES.items() if known & {*options}}
    require_columns(wanted.select(*(F.lit(None).alias(n) for n in found)), ["date", "mktrf"])
    if len({"smb", "hml", "rf"} & {*found}) < 2:
        raise ValueError("a factor table needs two of smb, hml and rf")
    out = resolve(wanted, found, required=("date", "mktrf"))
    kind = out.schema["date"].dataType
    if not isinstance(kind, T.NumericType | T.StringType):
        return out.where(date_predicate(kind, "date", start, end)).withColumn("date", F.col("date").cast("date"))
    return out.withColumn("date", parse_date(F.col("date"), kind)).where(date_predicate(T.DateType(), "date", start, end))


def sample_scan(df: DataFrame, predicate: str, n: int) -> DataFrame:
    """``n`` rows of the window, or of the whole where the window has none."""
    part = df.where(predicate).limit(n)
    return df.limit(n) if part.isEmpty() else part


def read_csv(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A CSV with a header; without a path an empty table."""
    return spark.read.csv(path, header=True, schema=schema) if path else spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_by_year(df: DataFrame, path: str, order: tuple[str, ...] = ("month_date", "manager_id", "permno")) -> None:
    """Folders by ``year``, sorted inside; AQE splits a year that is too large for a task."""
    spread = df.hint("rebalance", "year")
    spread.sortWithinPartitions("year", *order).write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
