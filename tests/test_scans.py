"""Windows, readers and sinks."""

from datetime import date, datetime

import pytest
from pyspark.sql import types as T

from holdlens.plans import queries
from holdlens.sources import scans


def test_windows_leave_no_row_out(spark):
    times = [datetime(2020, 3, 31, 23, 59), datetime(2020, 4, 1), datetime(2020, 1, 1), datetime(2019, 12, 31, 12)]
    windows = [("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-06-30")]
    found = lambda df, kind, **more: [df.where(scans.date_predicate(kind, "d", a, b, **more)).count() for a, b in windows]
    assert found(spark.createDataFrame([(t,) for t in times], "d timestamp"), T.TimestampType()) == [2, 1]
    assert found(spark.createDataFrame([(t.date(),) for t in times], "d date"), T.DateType()) == [2, 1]
    assert found(spark.createDataFrame([(t.isoformat(" "),) for t in times], "d string"), T.StringType()) == [2, 1]
    assert found(spark.createDataFrame([(f"{t:%Y%m%d}",) for t in times], "d string"), T.StringType(), compact=True) == [2, 1]
    assert found(spark.createDataFrame([(int(f"{t:%Y%m%d}"),) for t in times], "d long"), T.LongType()) == [2, 1]


def test_calendar_windows(spark):
    got = [(str(r.window_start), str(r.window_end)) for r in scans.calendar_windows(spark, "1996-11-28", "1997-06-05", 4).collect()]
    assert got == [("1996-11-01", "1997-02-28"), ("1997-03-01", "1997-06-05")]


def test_sample_falls_back_to_the_whole(spark):
    df = spark.range(10)
    assert scans.sample_scan(df, "id > 7", 5).count() == 2 and scans.sample_scan(df, "id > 70", 5).count() == 5


def test_sinks_and_csv(spark, tmp_path):
    rows = [(date(2020, 1 + k % 3, 1), "m", k, 2019 + k % 2) for k in range(6)]
    df = spark.createDataFrame(rows, "month_date date, manager_id string, permno long, year int")
    scans.write_parquet(df, str(tmp_path / "p"))
    scans.write_by_year(df, str(tmp_path / "y"))
    scans.write_csv(df.select("permno", "year"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    assert sorted(x.name for x in (tmp_path / "y").glob("year=*")) == ["year=2019", "year=2020"]
    assert sorted((r.permno, r.year) for r in scans.read_csv(spark, str(tmp_path / "c"), "permno long, year int").collect()) == sorted((r[2], r[3]) for r in rows)
    assert scans.read_csv(spark, None, "permno long").count() == 0


def test_jdbc_windows_are_partitions(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(k, 20200128 + 100 * k) for k in range(6)], "id long, d long")
    df.write.jdbc(url, "held", properties=driver)
    windows = [("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-05-31")]
    got = scans.read_jdbc_windows(spark, url, "held", ["id"], '"d"', windows, T.LongType(), properties=driver)
    assert got.rdd.getNumPartitions() == 2 and sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    assert scans.read_jdbc(spark, url, "held", ["id"], driver).count() == 6


def test_factor_tables_of_several_makes(spark):
    days = [datetime(1996, 12, 31, 8), datetime(1997, 1, 31, 23, 30), datetime(1997, 2, 28)]
    made = [(d, 0.01 * k, 0.02, 0.03, "x") for k, d in enumerate(days)]
    stamped = spark.createDataFrame(made, "CalDt timestamp, `Mkt-RF` double, SMB double, hml double, note string")
    got = scans.factor_scan(stamped, "1997-01-01", "1997-01-31")
    assert got.columns == ["date", "mktrf", "smb", "hml"] and [tuple(r) for r in got.collect()] == [(date(1997, 1, 31), 0.01, 0.02, 0.03)]
    numbers = spark.createDataFrame([(199612, 1.0, 2.0, 3.0), (199701, 4.0, 5.0, 6.0)], "month long, mkt double, rf double, smb double")
    assert [tuple(r) for r in scans.factor_scan(numbers, "1997-01-01", "1997-12-31").collect()] == [(date(1997, 1, 1), 4.0, 6.0, 5.0)]
    for bad, why in ((stamped.drop("CalDt"), "date"), (stamped.drop("Mkt-RF"), "mktrf"), (stamped.drop("SMB"), "two of")):
        with pytest.raises(ValueError, match=why):
            scans.factor_scan(bad, "1997-01-01", "1997-01-31")


def test_changed_tables_are_read_again(spark, tmp_path):
    for t, n in (("lineitem", 3), ("part", 2)):
        spark.range(n).write.parquet(str(tmp_path / f"{t}.parquet"))
    first = queries.build(spark, str(tmp_path))
    assert queries.build(spark, str(tmp_path)) is first
    spark.range(1).write.mode("append").parquet(str(tmp_path / "part.parquet"))
    assert queries.build(spark, str(tmp_path)) is not first
