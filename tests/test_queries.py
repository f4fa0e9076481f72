"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from webloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks client_changes".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    root = Path(__file__).resolve().parent.parent / "webloom"
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert "webloom.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()


def test_batch_plans(spark):
    """Top-k needs no full sort, fair batches no global window, and scans read only what they need."""
    plan = lambda name: catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan("frontier_top_k")
    assert "WindowGroupLimit" in plan("frontier_fair_batch")
    assert "ReadSchema: struct<url:string>" in plan("canonical_urls") and "Python" not in plan("canonical_urls")
