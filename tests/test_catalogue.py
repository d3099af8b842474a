"""Every query of the catalogue against its SQL, and the driver's entry."""

import math
import os

import pytest

from shelfscope.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_admission_equals_a_loop(spark):
    from shelfscope.operators.jobs import Limiter

    got = {r.event_id: r.admitted for r in catalogue.QUERIES["admission"](spark, DATA).collect()}
    rows = sorted(spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS at", "event_id").collect())
    limiters = {}
    want = {e: limiters.setdefault(u, Limiter(1, 600_000_000)).admit(at) for u, at, e in rows}
    assert got == want and 0 < sum(want.values()) < len(want)
