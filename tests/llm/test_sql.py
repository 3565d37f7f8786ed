"""Every registered query of this subpackage that has SQL gives its rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from heddle.llm import registry

SF = os.environ.get("HEDDLE_TEST_SF", "/root/testdata/sf0.001")


def _text(v):
    return "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = entry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.select(*want.columns).collect()
    assert sorted(tuple(map(_text, r)) for r in rows) == sorted(tuple(map(_text, r)) for r in want.fetchall())
