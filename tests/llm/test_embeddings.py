"""Top-k search and whitening against numpy over all pairs and the whole covariance."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm import topk, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, score string"


def odd_vectors() -> list[tuple]:
    """Ties, repeats, nulls, infinities, other lengths, nothing at all."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)], "clash") for i in range(300)]
    rows += [(300 + i, [0.5, 0.25, -1.0, 0.0, 0.125, 2.0], "hot") for i in range(150)]
    rows += [(None, [3.0] * 6, "x"), (7, rows[7][1], "again"), (100, rows[100][1], "again"), (100, [9.0, 0.0], "short")]
    return [*rows, (500, None, "x"), (600, [1.0, None, 2.0, 0.0, 0.0, 0.0], "x"), (700, [math.inf] * 6, "x"), (800, [math.nan] * 6, "x"), (900, [], "x")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}/v"
    spark.createDataFrame(odd_vectors(), SCHEMA).repartition(7).write.parquet(path)
    return spark.read.parquet(path)


def whole(rows, scale: int, wide: int) -> list[tuple]:
    out = []
    for r in rows:
        v = r["embedding"]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((r["vec_id"], [math.floor(x * scale) for x in v] + [0] * (wide - len(v))))
    return out


def brute_top(rows: list[tuple], every: int, k: int) -> list[tuple]:
    out = []
    for i, (q, x) in enumerate(rows):
        if q is not None and q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v is None, v or 0) for j, (v, y) in enumerate(rows) if j != i)[:k]
            out += [(q, n + 1, None if none else v, -score) for n, (score, none, v) in enumerate(s)]
    return sorted(out, key=str)


def searched(table, every=100, **more):
    found = topk.top_k(table, "vec_id", "embedding", F.coalesce(F.col("vec_id") % every == 0, F.lit(False)), **more)
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()], key=str)


@pytest.mark.parametrize(("lists", "query_bytes"), [(2, topk.QUERY_BYTES), (1, topk.QUERY_BYTES), (4, 10), (9, 200)])
def test_top_k_equals_all_pairs(odd, lists, query_bytes):
    want = brute_top(whole(odd.collect(), 1024, 6), 100, 10)
    assert searched(odd, lists=lists, query_bytes=query_bytes) == want


def test_top_k_of_few_rows_and_none(spark, odd):
    few = odd.where("vec_id in (100, 7) or vec_id is null")
    assert searched(few) == brute_top(whole(few.collect(), 1024, 6), 100, 10)
    assert searched(odd.where("false")) == [] and searched(odd.where("vec_id = 1")) == []


def test_top_k_of_a_frame_that_is_no_file(spark):
    rows = [(i, [float(i % 5), float(i % 3)], "x") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert searched(df, 10, k=3) == brute_top(whole(df.collect(), 1024, 2), 10, 3)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [2.0**40 + i * 2.0**18, -(2.0**30), 1.0], "x") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    x = dict(whole(df.collect(), 1024, 3))
    scores = {(q, v): vectors.as_long(sum(a * b for a, b in zip(x[q], x[v], strict=True))) for q in (0, 10, 20) for v in x if v != q}
    assert scores[0, 1] == vectors.LONG and searched(df, 10) == sorted([(q, n + 1, v, scores[q, v]) for q in (0, 10, 20) for n, v in enumerate(sorted((v for v in x if v != q), key=lambda v: (-scores[q, v], v))[:10])], key=str)
    small = spark.createDataFrame([(i, [2.0**20 + i, -(2.0**14) * i], "x") for i in range(30)], SCHEMA.replace("float", "double"))
    assert searched(small, 10) == brute_top(whole(small.collect(), 1024, 2), 10, 10)


def test_cutoff_prunes(spark, sf_dir):
    """Entries that reach phase 3 are a small part of all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(rows.embedding).astype(float) * 1024)
    parts = topk.partial_scores(x, x[:5], 2)
    best = np.sort(sum(parts), axis=0)[-10]
    assert (np.maximum(*parts) * 2 >= best).mean() < 0.5 and np.array_equal(sum(parts), x @ x[:5].T)


# ---------------------------------------------------------------- whitening


def brute_whitening(rows: list[tuple], k: int = 4):
    """Covariance of the distinct vectors, whole; per row exact deviation and whitened values."""
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    d = fit - fit.mean(axis=0)
    values, turn = np.linalg.eigh(d.T @ d / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    trace = float(np.trace(d.T @ d / n))
    out = defaultdict(list)
    for v, x in rows:
        w = (np.array(x) - fit.mean(axis=0)) @ turn / np.sqrt(values)
        out[v].append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w))
    return out, values / trace


def assert_whitened(df, rows, k=4):
    want, explained = brute_whitening(rows, k)
    got = defaultdict(dict)
    for r in df.collect():
        got[r.vec_id].setdefault(r.component, []).append(r)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-9
    assert set(got) == set(want)
    for c in range(1, len(explained) + 1):
        mine = [(r.n, r.deviation, r.whitened) for v in got for r in got[v][c]]
        theirs = [(n, dev, w[c - 1]) for v in want for n, dev, w in want[v]]
        big = max(theirs, key=lambda t: abs(t[2]))
        near = next(m for m in mine if m[1] == big[1] and math.isclose(abs(m[2]), abs(big[2]), rel_tol=1e-9))
        sign = 1 if near[2] * big[2] > 0 else -1
        assert sorted((n, d, round(sign * w, 8) + 0.0) for n, d, w in mine) == sorted((n, d, round(w, 8) + 0.0) for n, d, w in theirs)


def test_whitening_equals_the_whole_covariance(odd):
    assert_whitened(whitening.whitened(odd, "vec_id", "embedding"), whole(odd.collect(), 256, 6))


def test_query_equals_the_whole_covariance(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert_whitened(whitening.op13_whitening(spark, sf_dir), whole(table.collect(), 256, 64))


def test_whitening_without_variance(spark, odd):
    for where, components in (("false", 0), ("vec_id = 300", 0), ("vec_id between 300 and 320", 0), ("vec_id in (1, 2)", 1), ("vec_id in (1, 2, 3, 301, 302)", 3)):
        rows = whitening.whitened(odd.where(where), "vec_id", "embedding").collect()
        assert {r.component for r in rows} == set(range(1, components + 1)), where


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(i, [2.0**30 * i, 1.0 * i * i], "x") for i in range(4)], SCHEMA.replace("float", "double"))
    rows = {r.vec_id: r for r in whitening.whitened(df, "vec_id", "embedding").where("component = 1").collect()}
    assert [rows[i].deviation for i in range(4)] == [min(vectors.LONG, (4 * 2**38 * i - 6 * 2**38) ** 2 + (4 * 256 * i * i - 256 * 14) ** 2) for i in range(4)]


@pytest.mark.parametrize("gap", [0.5, 0.999, 1.0])
def test_leading_components_without_a_gap(gap):
    rng = np.random.default_rng(1)
    wide = 150
    q = np.linalg.qr(rng.normal(size=(wide, wide)))[0]
    v = (q * gap ** np.arange(wide)) @ q.T
    calls = []
    found = whitening.leading(lambda b: calls.append(1) or v @ b, wide, 4, extra=4, kept=40)
    assert np.allclose(found.values, gap ** np.arange(4), atol=1e-12) and found.residuals.max() < 1e-11
    assert np.allclose(np.abs(found.vectors.T @ found.vectors), np.eye(4), atol=1e-12) and len(calls) == found.passes
