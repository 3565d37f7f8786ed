"""Every registered query that has SQL gives its rows, and streams run to their end."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("HEDDLE_TEST_SF", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _text(v):
    if v is None:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_text(r[i]) for i in order) for r in rows)


#: At the smallest scale its windows hold no rows of some kinds.
NAMES = [n for n in entry.oracle_sql() if not re.match(r"op\d+_", n)]


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    found = duck.sql(entry.oracle_sql()[name])
    assert got == _rows(found.columns, found.fetchall())


@needs_data
def test_rows_only(spark):
    names = [n for n in entry.queries() if n not in entry.oracle_sql() and not re.match(r"op\d+_", n) and n != "pipeline"]
    assert all(entry.queries()[n](spark, SF).count() > 0 for n in names)


@needs_data
def test_plans(spark):
    """The scan reads the columns it needs and filters there; small sides are broadcast by Spark's own check."""
    plan = entry.queries()["q_flagship"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate", plan)
    point = entry.queries()["scan_point_lookup"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,77)" in point
    top = entry.queries()["vector_exact"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top and "Python" not in top
