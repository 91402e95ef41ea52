"""The training-data queries against their SQL in DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
NAMES = [n for n in entry.oracle_sql() if n.startswith(("p2_", "p4_", "p5_", "p6_", "p7_", "p8_", "p9_"))]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    sys.argv, before = ["compare", str(FOLDER)], sys.argv
    try:
        from compare import canon
    finally:
        sys.argv = before
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, str(FOLDER))
    out = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(out.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(list(out.columns), out.fetchall())


def test_mixture_keeps_to_its_targets(spark):
    shares = {r["source"]: r for r in entry.queries()["p8_shares"](spark, str(FOLDER)).collect()}
    mix = entry.queries()["p8_mixture"](spark, str(FOLDER)).collect()
    assert sum(r["tokens"] for r in shares.values()) == sum(r["tokens"] for r in mix)
    assert [r["position_key"] for r in mix] == sorted(r["position_key"] for r in mix)
