import duckdb
import pytest

import __spark_entry__ as entry
from holdlens.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry_names():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert len(got) == len(want)
    columns = sorted(want.columns)
    for df in (got, want):
        for c in columns:
            df[c] = df[c].astype("string") if df[c].dtype == object or "datetime" in str(df[c].dtype) else df[c].astype("float64")
    got, want = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    for c in columns:
        if got[c].dtype == "float64":
            assert (got[c].isna() == want[c].isna()).all() and (((got[c] - want[c]).abs() / want[c].abs().clip(lower=1)).fillna(0) < 1e-5).all()
        else:
            assert (got[c].str.slice(0, 10) == want[c].str.slice(0, 10)).fillna(True).all()
