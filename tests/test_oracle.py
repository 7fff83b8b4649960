"""Every registered job against its DuckDB oracle at sf0.01 (the driver's
correctness gate): row count, column names, order-insensitive value hash."""

import os
import sys

import duckdb
import pytest

from conftest import SF_MID

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, _digest  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_MID, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


def test_every_query_has_an_oracle():
    """Every query of the catalog; others only where SQL can express them."""
    from rollcall.plans import catalog
    assert set(catalog.queries()) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_MID)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["cluster", "idx", "node", "mac", "ip", "is_master", "n", "up", "line"]


SCAN_JOBS = ["fleet_scan", "node_context", "report_coverage", "apply_checkins", "all_up_at",
             "latch_on", "latch_off", "latch_on_stream"]


@pytest.mark.parametrize("name", SCAN_JOBS)
def test_query_matches_oracle_on_split_path(spark, con, name):
    """Every ordered scan forced onto the chunked path (as if every cluster,
    node and MAC were hot): same answers."""
    spark.conf.set("rollcall.scan.maxGroupRows", "3")
    try:
        df = E.queries()[name](spark, SF_MID)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("rollcall.scan.maxGroupRows")
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)
