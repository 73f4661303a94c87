"""Exact top-k search by inner product: the three-phase uniform threshold algorithm.

A score is the sum of ``lists`` partial scores, each over a block of dimensions; all partial
scores of a block make a list. A task holds every list of its own rows.

1. Each task gathers, list by list, the k rows of its batch with the highest partial scores and
   scores these in full. The k-th best over all tasks is a safe cutoff: no lower score is wanted.
2. The cutoff goes back to the tasks. A score of at least the cutoff has a partial score of at
   least its ``lists``-th part in some list: the uniform threshold. Entries over it are collected.
3. Their other partial scores are looked up where the row is, and exact scores below the cutoff go.
   A task sends on the k best of each query at most; these are ranked over all tasks.

Queries go to the tasks in blocks of ``QUERY_BYTES`` at most, so neither the driver nor a worker
ever holds more of them; every block meets all rows. Scores are exact whole numbers of any size.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part,
neither as query nor as candidate; vectors of other lengths end in zeros; ties go to the smaller
id, a null id last, then to the row's place in its file; a query is its row, so repeated ids are
queries and candidates of their own; with fewer than k candidates all are returned; scores outside
of a long are, and rank as, the nearest long; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .shared import fresh, row_keyed, scratch_path, small_batches, stored, temporary, tracked

K, LISTS, SCALE = 10, 2, 1024
QUERY_BYTES = 32 << 20
QUERY_ROWS = 512  # queries that a matrix of partial scores has
SCORES = "q int, score long"
FOUND = "query_id long, asked string, vec_id long, at string, score long"


class Asked:
    """A block of queries: ids, row keys, their matrix, and the cutoffs once they are known."""

    def __init__(self, ids: list, keys: list[str], x: np.ndarray):
        self.ids, self.keys, self.x = ids, {k: i for i, k in enumerate(keys)}, x
        self.names, self.cut = keys, None


def partial_scores(x: np.ndarray, q: np.ndarray, lists: int) -> list[np.ndarray]:
    """A (rows, queries) matrix for each list; exact, with Python's whole numbers where doubles would not be."""
    if x.size and q.size and (x.dtype == object or q.dtype == object or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= vectors.EXACT):
        x, q = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (x, q))
    edges = np.linspace(0, x.shape[1], lists + 1).astype(int)
    return [x[:, a:b] @ q[:, a:b].T if b > a else np.zeros((len(x), len(q))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _scored(batches: Iterator[pa.RecordBatch], asked: Asked, wide: int, scale: int, lists: int):
    """(first query, batch rows, ids, keys, partial scores, own) of each matrix; ``own`` marks a query's own row."""
    for batch in batches:
        ids, keys = batch.column("_id").to_pylist(), batch.column("_at").to_pylist()
        for rows, x in vectors.matrices(batch, "_vector", scale, wide):
            mine = [(i, asked.keys[keys[r]]) for i, r in enumerate(rows) if keys[r] in asked.keys]
            for k in range(0, len(asked.ids), QUERY_ROWS):
                q = asked.x[k : k + QUERY_ROWS]
                own = np.zeros((len(rows), len(q)), bool)
                for i, j in mine:
                    if k <= j < k + len(q):
                        own[i, j - k] = True
                yield k, [ids[r] for r in rows], [keys[r] for r in rows], partial_scores(x, q, lists), own


def _total(parts: list[np.ndarray]) -> np.ndarray:
    total = sum(parts)
    return np.clip(total, -vectors.LONG - 1, vectors.LONG) if total.dtype == object else total


def _highest(x: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each column, in no order."""
    return x if len(x) <= k else np.sort(x, axis=0)[-k:] if x.dtype == object else np.partition(x, len(x) - k, axis=0)[-k:]


def gathered(asked, k: int, wide: int, scale: int, lists: int) -> Callable:
    """Phase 1: scores of the rows that lead a list of their batch, the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Asked = asked.value
        best: dict[int, np.ndarray] = {}
        for first, _, _, parts, own in _scored(batches, block, wide, scale, lists):
            total = np.where(own, -np.inf, _total(parts))
            seen = np.zeros(total.shape, bool)
            for p in parts:
                p = np.where(own, -np.inf, p)
                seen |= p >= _highest(p, k).min(axis=0)
            total = np.where(seen, total, -np.inf)
            best[first] = _highest(np.concatenate([best[first], total]) if first in best else total, k)
        out = [(first + j, vectors.as_long(s)) for first, m in best.items() for j in range(m.shape[1]) for s in m[:, j] if s != -np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([s for _, s in out], pa.int64())], ["q", "score"])

    return run


def resolved(asked, k: int, wide: int, scale: int, lists: int) -> Callable:
    """Phases 2 and 3: entries over the uniform threshold in some list, scored exactly, the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Asked = asked.value
        best: dict[int, list[tuple]] = {}
        for first, ids, keys, parts, own in _scored(batches, block, wide, scale, lists):
            cut = block.cut[first : first + own.shape[1]]
            over = np.zeros(own.shape, bool)
            for p in parts:
                over |= lists * p >= cut
            total = _total(parts)
            over &= (total >= cut) & ~own
            for j in np.flatnonzero(over.any(axis=0)):
                at = np.flatnonzero(over[:, j])
                if len(at) > k:  # ties with the k-th best stay, so that ids decide among them
                    at = at[total[at, j] >= np.sort(total[at, j])[-k]]
                found = [(-int(total[i, j]), ids[i] is None, ids[i] or 0, keys[i]) for i in at]
                best[first + j] = sorted([*best.get(first + j, []), *found])[:k]
        out = [(block.ids[q], block.names[q], None if none else i, key, vectors.as_long(-s)) for q, rows in best.items() for s, none, i, key in rows]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for n in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[n : n + 10_000], strict=True), kinds, strict=True)], ["query_id", "asked", "vec_id", "at", "score"])

    return run


def _blocks(queries: DataFrame, wide: int, limit: int) -> int:
    """How many blocks by hash of the row keep each at ``limit`` queries."""
    total = queries.count()
    n = max(1, -(-total // limit))
    while n > 1 and queries.groupBy(F.pmod("_h", F.lit(n))).count().agg(F.max("count")).first()[0] > limit:
        n *= 2
    return n if total else 0


def top_k(table: DataFrame, id: str, vector: str, is_query: Column, k: int = K, scale: int = SCALE, lists: int = LISTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, asked, rank, vec_id, at, score) of the k best rows for each row of ``table`` for which ``is_query`` holds.

    ``asked`` and ``at`` name the query's row and the found one where ids do not.
    """
    spark = table.sparkSession
    small_batches(spark)
    flag = fresh(table, "_is_query")
    path = scratch_path(spark, "found")
    with temporary(spark):
        keyed, keys = row_keyed(table.withColumn(flag, is_query), "vectors")
        rows = keyed.select(F.col(id).cast("long").alias("_id"), F.concat_ws(":", *keys).alias("_at"), F.col(vector).alias("_vector"), F.col(flag).alias("_asked"))
        wide = vectors.width(rows, "_vector")
        queries = stored(rows.where("_asked and _vector is not null").select("_id", "_at", "_vector", F.xxhash64("_at").alias("_h")), "queries")
        n = _blocks(queries, wide, max(1, query_bytes // (8 * max(1, wide))))
        for b in range(n):
            block = _asked(queries.where(F.pmod("_h", F.lit(n)) == b).drop("_h").orderBy("_at"), scale, wide)  # query_bytes at most
            if block.ids:
                _answer(rows, block, k, wide, scale, lists).write.mode("append").parquet(path)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    found = tracked(spark, path, FOUND)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "asked", "rank", "vec_id", "at", "score")


def _asked(queries: DataFrame, scale: int, wide: int) -> Asked:
    ids, keys, parts = [], [], []
    for batch in queries.toArrow().to_batches():
        own_ids, own_keys = batch.column("_id").to_pylist(), batch.column("_at").to_pylist()
        for rows, x in vectors.matrices(batch, "_vector", scale, wide):
            ids += [own_ids[r] for r in rows]
            keys += [own_keys[r] for r in rows]
            parts.append(x)
    return Asked(ids, keys, np.concatenate(parts) if parts else np.zeros((0, wide)))


def _answer(rows: DataFrame, block: Asked, k: int, wide: int, scale: int, lists: int) -> DataFrame:
    """Candidates of one block of queries, k of each query and task at most."""
    context, slim = rows.sparkSession.sparkContext, rows.select("_id", "_at", "_vector")
    first = context.broadcast(block)
    lead = slim.mapInArrow(gathered(first, k, wide, scale, lists), SCORES)
    lead = lead.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") <= k)
    cuts = lead.groupBy("q").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()  # a row for each query of the block
    first.unpersist()
    cut = np.full(len(block.ids), -np.inf, object if any(abs(r.score) >= vectors.EXACT for r in cuts) else float)
    for r in cuts:
        cut[r.q] = r.score if r.score > -vectors.LONG - 1 else -np.inf
    block.cut = cut
    return slim.mapInArrow(resolved(context.broadcast(block), k, wide, scale, lists), FOUND)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = top_k(table, "vec_id", "embedding", F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


QUERIES = {"op12_exact_top_k": op12_exact_top_k}
ORACLES = {
    "op12_exact_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS rank FROM s) WHERE rank <= 10
"""
}
