"""Helpers that several operators share: scratch tables, columns from texts, row keys, distributed ranks, block hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..session import owned, remove_path, scratch_dir, small_batches, temporary
from ..session import scratch as scratch_path

__all__ = ["remove_path", "scratch_dir", "scratch_path", "small_batches", "temporary"]
U64 = np.uint64

# ---------------------------------------------------------------- scratch


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs here go when it has ended; nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with cleaned_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def tracked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was appended to ``path`` part by part, as a stored frame; without rows if nothing was."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    owned(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(df: DataFrame, names: tuple[str, ...] | list[str]) -> list[str]:
    """The columns of ``df`` not called as any of ``names``, in either case."""
    lowered = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lowered]


def named(columns: list[str]) -> list[Column]:
    """Columns by their names as they are, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


# ---------------------------------------------------------------- columns from texts

def text_udf(f: Callable[[Iterator[list[bytes | None]]], Iterator[list]], kind: DataType | str) -> Callable[..., Column]:
    """A column from texts: ``f`` maps lists of UTF-8 bytes (or None) to lists of values or dicts of ``kind``.

    Only the text goes to Python; a row's other columns stay in the JVM.
    """
    kind = DataType.fromDDL(kind) if isinstance(kind, str) else kind
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in f(a.cast(pa.binary()).to_pylist() for a in batches):
            yield pa.array(values, arrow)

    small_batches(SparkSession.active())
    return F.arrow_udf(run, kind).asNondeterministic()  # so that no filter on it is worked out a second time


# ---------------------------------------------------------------- row keys


def row_keyed(docs: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns that tell its rows apart whenever it is read, and their names.

    Rows of Parquet files are named by a hash of their file and their place in it. Anything
    else, whose rows might come in another order the next time, is stored first.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().apply(0)
    keys = [fresh(docs, "_file"), fresh(docs, "_place")]
    if node.nodeName() == "LogicalRelation":
        try:
            at = docs.metadataColumn("_metadata")
            return docs.select("*", F.xxhash64(at["file_path"]).alias(keys[0]), at["row_index"].alias(keys[1])), keys
        except AnalysisException:  # files without places
            pass
    return row_keyed(stored(docs, name), name)


def joined_back(docs: DataFrame, slim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``docs`` (keyed) joined to ``slim`` (keyed, without texts) by row: hashed on the slim side, so no text is sorted."""
    return docs.join(slim.hint("shuffle_hash"), keys, how).drop(*keys)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text, mod ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


# ---------------------------------------------------------------- ranks


def ranked(df: DataFrame, group: str, order: list[str], out: str, rows_per_part: int = 200_000, name: str = "rank") -> DataFrame:
    """Adds ``out``: 0-based rank within ``group`` by ``order``, without one task per group.

    Rows are range-partitioned and sorted by (group, order), so a hot group spreads over
    many partitions; a row's place in its partition, less the place of its group's first
    row there, plus the group's rows in earlier partitions, is its rank. The offsets table
    has one row for each (partition, group) that meet. Rows equal in all those columns may
    take either rank.
    """
    spark = df.sparkSession
    parts = max(-(-df.count() // rows_per_part), spark.sparkContext.defaultParallelism)
    at, part, tie, n, first, p, g, shift = (fresh(df, c) for c in ("_at", "_part", "_tie", "_n", "_first", "_p", "_g", "_shift"))
    keys = [F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]]
    cut = df.withColumn(tie, F.rand(7)).repartitionByRange(parts, *keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie))
    cut = stored(cut.drop(tie).withColumn(at, F.monotonically_increasing_id()), name)
    cut = cut.withColumn(part, F.shiftright(at, 33))
    counts = cut.groupBy(part, group).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias(p), F.col(group).alias(g), (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(shift))
    return (
        cut.join(offsets, (F.col(part) == F.col(p)) & F.col(group).eqNullSafe(F.col(g)))
        .withColumn(out, (F.col(at) + F.col(shift)).cast("long"))
        .drop(at, part, p, g, shift)
    )


# ---------------------------------------------------------------- words and hashes in numpy

#: bytes that part words: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEGMENT = 1 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], U64))[0])


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def words_of(buf: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end (exclusive)."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = sep[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums over segments that end between words."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        at = int(starts[i])
        part = buf[at : int(ends[j - 1])]
        pw, inv = _pow(len(part) + 1)
        acc = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * pw[: len(part)], out=acc[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def joined_texts(texts: list[bytes], limit: int = SEGMENT):
    """Runs of texts of about ``limit`` bytes: (first, last, joined bytes, offset of each text)."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= limit):
            total += len(texts[j]) + 1
            j += 1
        offsets = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts[i:j]], out=offsets[1:])
        yield i, j, b"\n".join(texts[i:j]), offsets
        i = j
