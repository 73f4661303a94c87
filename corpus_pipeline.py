"""From raw documents to shards: each stage takes the documents that the one before kept.

1. quality rules: documents that a rule rejects go.
2. near-duplicates: of each component (Jaccard of 0.8 or more on 5-word shingles) the smallest doc_id stays.
3. benchmark decontamination: documents with a twentieth or more of their words in benchmark windows go.
4. mixing: a document appears as often as its source's target weight has it, none to twice.
5. sharding: every row gets a shard and its place in it.

All stages but the last return the columns of documents, whatever they are called; the last adds
size, text_crc32, vslot, shard, slot and split, which replace columns of those names. A stage works
on rows without their texts and moves a text once at most: quality and decontamination filter where
the rows are, the others join a slim verdict back by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandloom.llm import decontaminate, mixing, neardup, quality, sharding
from bandloom.llm.shared import stored, temporary

SHARDS = 16
SIMILARITY = 80  # per cent


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Near-duplicate components and the slot map are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark) as keep:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        return keep(docs)
