"""Queries that have SQL equal DuckDB over the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from bandloom.llm.queries import ORACLES, QUERIES
from bandloom.session import scratch_dir, temporary


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def scratch_tables(spark) -> set[str]:
    at = scratch_dir(spark).removeprefix("file://") + "/bandloom"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_leave_nothing_behind(spark, sf_dir, name):
    before = scratch_tables(spark)
    with temporary(spark):
        assert QUERIES[name](spark, sf_dir).count()
    assert scratch_tables(spark) == before


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    before = scratch_tables(spark)
    with temporary(spark):
        df = QUERIES[name](spark, sf_dir)
        columns, got = sorted(df.columns), df.collect()
    assert scratch_tables(spark) == before
    rows = con.execute(ORACLES[name])
    names = [x[0] for x in rows.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert sorted(names) == columns and Counter(tuple(plain(r[c]) for c in columns) for r in got) == want
