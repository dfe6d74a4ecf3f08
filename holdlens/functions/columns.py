"""Scalar columns: parsing, calendar and null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, aliases: dict[str, list[str]], *, required: tuple[str, ...] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """Logical columns from the first alias that ``df`` has, whatever its case.

    A missing required column raises; another one is its default or null.
    """
    lower = {c.lower(): c for c in reversed(df.columns)}
    out = []
    for name, options in aliases.items():
        actual = next((lower[a.lower()] for a in options if a.lower() in lower), None)
        if actual is not None:
            out.append(F.col(f"`{actual}`").alias(name))
        elif name in required:
            raise ValueError(f"no column for {name}: looked for {options}")
        else:
            out.append((defaults or {}).get(name, F.lit(None)).alias(name))
    return df.select(*out)


def role_columns(columns: list[str], aliases: dict[str, list[str]], preferred: tuple[str, ...] = (), cap: int = 64) -> list[str]:
    """Columns worth reading: alias hits in order, then preferred ones, then the first 20; at most ``cap``."""
    lower = {c.lower(): c for c in columns}
    hits = [lower[a.lower()] for options in aliases.values() for a in options if a.lower() in lower]
    hits += [lower[p.lower()] for p in preferred if p.lower() in lower]
    return list(dict.fromkeys([*hits, *columns[:20]]))[:cap] if not hits else list(dict.fromkeys(hits))[:cap]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def finite(c: Column) -> Column:
    """The value as double, null where it isn't a finite number."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def cusip8(c: Column) -> Column:
    """Letters and digits in upper case, the first eight; null below six."""
    x = F.substring(F.regexp_replace(F.upper(c.cast("string")), "[^A-Z0-9]", ""), 1, 8)
    return F.when(F.length(x) >= 6, x)


def parse_number(c: Column, kind: T.DataType) -> Column:
    """A number; of a text its digits, points and minus signs, null where they make no number."""
    return finite(c) if not isinstance(kind, T.StringType) else finite(F.regexp_replace(c, r"[^0-9.\-]", ""))


def parse_date(c: Column, kind: T.DataType) -> Column:
    """A date from a date, a timestamp, ``yyyyMMdd`` or ``yyyyMM`` as a number, or an ISO or ``yyyyMMdd`` text."""
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return c.cast("date")
    numeric = isinstance(kind, T.NumericType)
    text = c.cast("decimal(20,0)").cast("string") if numeric else F.trim(c.cast("string"))
    day = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
    if numeric:
        return F.coalesce(day, F.when(text.rlike(r"^\d{6}$"), F.try_to_timestamp(F.concat(text, F.lit("01")), F.lit("yyyyMMdd")).cast("date")))
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")), day)


def month_floor(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clamp(c: Column, low: Column, high: Column) -> Column:
    """``c`` moved into [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def position_value(reported: Column, shares: Column, price: Column) -> Column:
    """Reported value if positive, else shares at the absolute price if there is one, else shares."""
    return F.when(reported > 0, reported).when(F.abs(price) > 0, shares * F.abs(price)).otherwise(shares)


def annualizer(target: Column) -> Column:
    """Periods a year: 4 for three-month targets, else 12."""
    return F.when(target.endswith("3m"), F.lit(4.0)).otherwise(F.lit(12.0))


#: Last year of each regime and its label; later years have the last label.
REGIMES = [(2016, "2012_2016_early_oos"), (2019, "2017_2019_pre_covid"), (2020, "2020_covid"), (2022, "2021_2022_rate_hike"), (None, "2023_2025_recent")]


def regime(year: Column, regimes: list[tuple[int | None, str]] | None = None) -> Column:
    """Label of the first regime whose last year isn't before ``year``."""
    out = F.lit(None).cast("string")
    for last, label in reversed(regimes or REGIMES):
        out = F.lit(label) if last is None else F.when(year <= last, F.lit(label)).otherwise(out)
    return out
