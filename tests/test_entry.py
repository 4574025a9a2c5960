"""Every query of the driver's contract on the smallest data: it runs, and equals its SQL where it has some."""

import os
import sys
from pathlib import Path

import pytest

DATA = Path(os.environ.get("TRADELOOM_TESTDATA", "/root/testdata/sf0.001"))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def compiled(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(compiled, con, name):
    df = entry.queries()[name](compiled, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        cur = con.execute(entry.oracle_sql()[name])
        assert normal(df.columns, got) == normal([c[0] for c in cur.description], cur.fetchall())


def test_entry(compiled):
    assert entry.entry(compiled).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
