"""Every query runs and leaves nothing behind, and where it has SQL its rows equal DuckDB's on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from bandloom.plans.queries import ORACLES, QUERIES
from bandloom.session import scratch_dir, temporary

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def scratch_tables(spark) -> set[str]:
    at = scratch_dir(spark).removeprefix("file://") + "/bandloom"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    before = scratch_tables(spark)
    with temporary(spark):
        df = QUERIES[name](spark, sf_dir)
        columns = sorted(df.columns)
        got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert scratch_tables(spark) == before
    if name not in ORACLES:
        assert got
        return
    rows = duck.execute(ORACLES[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert got == want
