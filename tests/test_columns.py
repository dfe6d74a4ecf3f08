from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdlens.functions.columns import cusip8, parse_date, parse_number, resolve
from holdlens.sources.scans import calendar_windows, date_predicate


def _values(spark, values, kind, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(make(F.col("x"))).collect()]


def test_cusip8(spark):
    assert _values(spark, ["12a45b789", "\t88-77 66#55.4", None, "qrstuv", "z-9"], "string", cusip8) == ["12A45B78", "88776655", None, "QRSTUV", None]


def test_numbers_and_dates(spark):
    assert _values(spark, ["B", "0.01", "", "$1,000"], "string", lambda c: parse_number(c, T.StringType())) == [None, 0.01, None, 1000.0]
    assert _values(spark, [20200131, 202001, 99], "long", lambda c: parse_date(c, T.LongType())) == [date(2020, 1, 31), date(2020, 1, 1), None]
    assert _values(spark, ["2020-01-31", "20200131", "x", None], "string", lambda c: parse_date(c, T.StringType())) == [date(2020, 1, 31), date(2020, 1, 31), None, None]


def test_resolve_takes_the_first_alias_in_any_case(spark):
    df = spark.createDataFrame([(1, 2)], "MGRNO int, cik int")
    assert resolve(df, {"manager_id": ["manager_id", "mgrno", "cik"], "shares": ["shares"]}, defaults={"shares": F.lit(1.0)}).first().asDict() == {"manager_id": 1, "shares": 1.0}


def test_windows(spark):
    rows = calendar_windows(spark, "1997-08-09", "1998-03-02", 2).orderBy("window_start").collect()
    assert [(r.window_start, r.window_end) for r in rows] == [
        (date(1997, 8, 1), date(1997, 9, 30)), (date(1997, 10, 1), date(1997, 11, 30)), (date(1997, 12, 1), date(1998, 1, 31)), (date(1998, 2, 1), date(1998, 3, 2)),
    ]
    assert date_predicate(T.IntegerType(), "d", "1997-08-01", "1997-09-30") == "d BETWEEN 19970801 AND 19970930"
