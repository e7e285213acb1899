"""Every registered query of the core: it plans without a cross join, and equals its SQL on the smallest tables."""

import math
import os

import pytest

from memlode.plans import catalog

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return {"NaT": "null", "<NA>": "null", "nan": "null"}.get(str(v), str(v).replace("+00:00", ""))


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(sql.execute(catalog.oracle_sql()[name]).df())


def test_entry_works_with_and_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
