"""Every registered query over redo logs against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v


def rows(frame):
    return sorted(repr(tuple(map(plain, r))) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = sql.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want[list(got.columns)])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
