"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: weights share ``budget`` times all words, no
target passes ``most`` times its source, and what a full source can't take is shared again
by weight. Within a source every document expects ``target / source_size`` copies. Documents
stand in order of size, then id, then a hash of what else the row holds; the expected copies are summed along that order, one random
offset per source is added, and a document is emitted once for each integer boundary that
its stretch crosses. As sizes rise along the order, the words taken miss the target by no
more than about one largest document.

Texts are read twice, once for their sizes and once for the result: what is ranked and stored
has a row's key, id, source and size only, and copies are joined back to the rows by key.

Defined results: null text has size 0; a null source is a source, last in order; repeated
rows are rows of their own; a table without words has targets and copies of 0; extra columns
pass through :func:`mix`, replaced where they are called as those added, and :func:`repeated`,
which adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, joined_back, named, ranked, row_keyed, stored, temporary, without

WEIGHTS = (5, 2, 1)
SEED = 20240607


def word_count(column: str = "text") -> Column:
    """Words between space, \\t, \\n, \\v, \\f and \\r; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target), one row per source.

    The level at which uncapped sources get ``level * weight`` rises over a few rounds, each
    one global sum over the sources; nothing is collected but that sum.
    """
    sums = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_all", F.lit(0)), "sources")
    placed = ranked(sums, "_all", ["source"], "_place", name="sources-ranked").drop("_all")
    table = stored(placed.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))), "sources-weighed")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap, level = F.col("source_size") * F.lit(most), None
    while True:
        full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("_w")
        held, free, n = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w"))), F.count_if(full)).first()
        if not free:
            break
        new = (budget * total - (held or 0.0)) / free
        if level is not None and n == count:
            break
        level, count = new, n
    target = F.least(cap, F.lit(float(level or 0.0)) * F.col("_w"))
    return table.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source: the leading 32 bits of sha256('seed:source')."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary"), 256), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


ADDED = ("size", "source_size", "target", "copies")


def content(docs: DataFrame) -> Column:
    """A hash of a row's columns, so that rows alike in size and id stand in one order however they are laid out."""
    return F.xxhash64(*named([c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]))


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = SEED, tie: str | None = None) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size and any others) with source_size, target and copies; ``tie`` orders rows of one size and id."""
    sized = sized.select(*named(without(sized, ADDED[1:])))
    with temporary(sized.sparkSession) as keep:
        table = keep(stored(source_targets(sized.select("source", "size"), weights, budget, most), "targets"))
    rank, own = fresh(sized, "_rank"), fresh(sized, "_source")
    placed = ranked(sized, "source", ["size", "doc_id", *([tie] if tie else [])], rank, name="mix")
    t = table.select(F.col("source").alias(own), "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = offset_of(F.col("source"), seed)
    copies = F.floor(step + each * (F.col(rank) + 1)) - F.floor(step + each * F.col(rank))
    return placed.join(t, F.col("source").eqNullSafe(F.col(own))).withColumn("copies", copies.cast("long")).drop(own, rank)


def _by_row(docs: DataFrame, keyed: DataFrame, keys: list[str], how: dict) -> DataFrame:
    """Row keys with the columns that mixing adds."""
    sizes = stored(keyed.select(*keys, "doc_id", "source", word_count().alias("size"), content(docs).alias("_content")), "sizes")
    return mix_sized(sizes, tie="_content", **how).select(*keys, *ADDED)


def mix(docs: DataFrame, **how) -> DataFrame:
    """Rows and columns of ``docs`` with size, source_size, target and copies (0 to ``most``)."""
    docs = docs.select(*named(without(docs, ADDED)))
    keyed, keys = row_keyed(docs, "documents")
    return joined_back(keyed, _by_row(docs, keyed, keys, how), keys)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once for every copy."""
    keyed, keys = row_keyed(docs, "documents")
    times, again = fresh(keyed, "_times"), fresh(keyed, "_again")
    slim = _by_row(docs, keyed, keys, how).where("copies > 0").select(*keys, F.col("copies").cast("int").alias(times))
    return joined_back(keyed, slim, keys).withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*named(docs.columns))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sizes = docs.select("doc_id", "source", word_count().alias("size"), content(docs).alias("tie"))
    mixed = mix_sized(stored(sizes, "sizes"), tie="tie")  # texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The same in one statement: the level is the one that fills the budget when sources are capped in order of cap by weight.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(w) OVER (ORDER BY cap / w DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS free FROM w
), l AS (
  SELECT coalesce(arg_min((1.5::DOUBLE * total - held) / free, cap / w) FILTER (WHERE (1.5::DOUBLE * total - held) / free <= cap / w), 0) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, level * w) AS target,
    ('0x' || substr(sha256('20240607:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS step FROM w, l
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k FROM d
), c AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    CAST(floor(step + target / source_size * (k + 1)) - floor(step + target / source_size * k) AS BIGINT) AS copies
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

QUERIES = {"op6_mix_sources": op6_mix_sources}
ORACLES = {"op6_mix_sources": MIX_SQL}
