"""Every registered query against its DuckDB oracle on the smallest scale (the driver's gate)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _digest(columns, rows):
    """Of plain Python rows: a frame would turn whole numbers beside nulls into floats on one side only."""
    cols = sorted(columns)
    rows = sorted("\x1f".join(_norm(r[c]) for c in cols) for r in (dict(zip(columns, x, strict=True)) for x in rows))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df, sql = entry.queries()[name](spark, SF_SMALL), con.sql(entry.oracle_sql()[name])
    got, want = _digest(df.columns, df.collect()), _digest(sql.columns, sql.fetchall())
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "parameter_f1" in df.columns


def test_every_query_has_rows_or_oracle(spark):
    missing = set(entry.queries()) - set(entry.oracle_sql())
    # pack_whole is held against brute force in test_packing
    assert all(name.startswith("op") or name in ("pipeline", "pack_whole") for name in missing)
