"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record hashes to one of ``slots`` virtual slots; bytes are summed for each slot; a map
(version, vslot, shard, bytes, rows, subs) says which shard holds a slot. Rebalancing edits
the map, never the hash. The map has ``slots`` rows, a constant, so the driver may plan it.
A version has a folder of its own under ``map_path`` and never changes: a rerun that plans the
same map uses it, one that plans another is refused.

Copies of one text go to the same slot, so a group of copies is always in one shard, and shards are
as even as whole groups allow: one that weighs more than an even shard makes its shard that heavy. Where
evenness matters more, ``hot_share`` (0.9, say) deals out by id the copies of texts heavier than that part of
an even shard, marked ``split``; at most ``shards / hot_share`` texts can be, which bounds the list of them.
No task holds a heavy shard or slot: rows are numbered in cells of about ``ROWS_PER_CELL``.

Defined results: a null text has no bytes and hashes by its doc_id; size is UTF-8 bytes + 1;
repeated rows are rows of their own; an empty table gives an empty result and an empty map is
still written; columns whose names clash with the added ones are replaced by them, all others
pass through.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import joined_back, named, path_exists, row_keyed, scratch_path, stored, without

SLOTS = 4096
ROWS_PER_CELL = 100_000


def text_key() -> Column:
    return F.xxhash64("text", F.crc32(F.col("text").cast("binary")))


ADDED = ("size", "text_crc32", "vslot", "shard", "slot", "split")


def sized(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without their texts: keys, doc_id, size, text_crc32, and a key that copies share."""
    raw = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return keyed.select(F.struct(*keys).alias("row"), "doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), text_key().alias("copy"))


def heavy_texts(rows: DataFrame, shards: int, hot_share: float | None) -> list[int]:
    """Keys of texts whose copies exceed ``hot_share`` of an even shard, shards/hot_share at most; none without it."""
    if hot_share is None:
        return []
    groups = rows.where(F.col("text_crc32").isNotNull()).groupBy("copy").agg(F.sum("size").alias("b"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bound = max(1.0, total / shards * hot_share)
    return [r[0] for r in groups.where(F.col("b") > bound).select("copy").collect()]


def slotted(rows: DataFrame, slots: int, heavy: list[int]) -> DataFrame:
    own = F.xxhash64(F.col("doc_id").cast("string"), F.lit("row"))
    split = F.col("text_crc32").isNotNull() & (F.col("copy").isin(heavy) if heavy else F.lit(False))
    return rows.withColumn("split", split).withColumn("vslot", F.pmod(F.when(F.col("text_crc32").isNull() | split, own).otherwise(F.col("copy")), F.lit(slots)).cast("int"))


def balanced(weights: dict[int, int], shards: int, slots: int) -> list[int]:
    """Heaviest slot first to the lightest shard; ties by number."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda k: (-weights.get(k, 0), k)):
        load, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), n + 1, shard))
    return out


def rebalanced(previous: list[int], weights: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The previous map with as few slots moved as brings every shard within ``tolerance`` of even.

    New shards (numbers the map lacks) start empty; slots go from the fullest shard to the
    emptiest, each time the largest slot that fits, until none is over or under.
    """
    out = list(previous)
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(out):
        load[shard] += weights.get(slot, 0)
        held[shard].append(slot)
    even = sum(load.values()) / shards
    for _ in range(len(out)):
        src, dst = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        room = (load[src] - load[dst]) / 2
        fits = [k for k in held[src] if 0 < weights.get(k, 0) <= room]
        if (load[src] <= even * (1 + tolerance) and load[dst] >= even * (1 - tolerance)) or not fits:
            break
        slot = max(fits, key=lambda k: (weights[k], -k))
        held[src].remove(slot)
        held[dst].append(slot)
        out[slot] = dst
        load[src] -= weights[slot]
        load[dst] += weights[slot]
    return out


def map_frame(spark: SparkSession, version: int, shard_of: list[int], stats: dict[int, tuple[int, int]]) -> DataFrame:
    """The map as a frame, from literals: one row for each slot."""

    def array(values) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")

    n = len(shard_of)
    rows = [stats.get(k, (0, 0))[1] for k in range(n)]
    zipped = F.arrays_zip(
        array(range(n)).alias("vslot"), array(shard_of).alias("shard"), array(stats.get(k, (0, 0))[0] for k in range(n)).alias("bytes"),
        array(rows).alias("rows"), array(max(1, -(-r // ROWS_PER_CELL)) for r in rows).alias("subs"),
    )
    return (
        spark.range(1)
        .select(F.inline(zipped).alias("vslot", "shard", "bytes", "rows", "subs"))
        .select(F.lit(version).alias("version"), F.col("vslot").cast("int"), F.col("shard").cast("int"), "bytes", "rows", F.col("subs").cast("int"))
    )


MAP = "vslot int, shard int, bytes long, rows long, subs int"


def plan_shards(rows: DataFrame, shards: int, slots: int, map_path: str, previous: list[int] | None = None, version: int = 1) -> DataFrame:
    """Sums bytes by slot, plans or edits the map, writes it as ``version`` under ``map_path`` and reads it back.

    A version that is there already must be equal; a folder that a run left without its end mark is written again.
    """
    spark = rows.sparkSession
    stats = {r[0]: (r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    weights = {k: v[0] for k, v in stats.items()}
    shard_of = balanced(weights, shards, slots) if previous is None else rebalanced(previous, weights, shards)
    frame = map_frame(spark, version, shard_of, stats).drop("version")
    at = f"{map_path}/version={version}"
    if not path_exists(spark, f"{at}/_SUCCESS"):
        frame.coalesce(1).write.mode("overwrite").parquet(at)
    there = spark.read.schema(MAP).parquet(at)
    if sorted(map(tuple, there.collect())) != sorted(map(tuple, frame.collect())):  # ``slots`` rows
        raise ValueError(f"version {version} under {map_path} is another map; give a new version")
    return there


def planned(slim: DataFrame, shards: int, slots: int, hot_share: float | None, map_path: str, previous: list[int] | None, version: int) -> DataFrame:
    """Rows without texts as :func:`sized` gives them, with vslot, shard, split and slot.

    ``slot`` is the row's place in its shard, gapless from 0: the rows of the shard's earlier
    cells, plus its number in its own cell. A cell is a part of a slot of about
    ``ROWS_PER_CELL`` rows, so no task sees a whole hot slot.
    """
    rows = slotted(slim, slots, heavy_texts(slim, shards, hot_share))
    slot_map = plan_shards(rows, shards, slots, map_path, previous, version)
    rows = rows.join(F.broadcast(slot_map.select("vslot", "shard", "subs")), "vslot")  # a row for each slot: a constant
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("vslot", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "vslot", "sub").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("vslot", "sub", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("vslot", "sub").orderBy("doc_id", "text_crc32", "size", "row")
    numbered = rows.withColumn("own", F.row_number().over(inside)).join(cells, ["vslot", "sub"])
    return numbered.select("row", "doc_id", "size", "text_crc32", "vslot", "shard", (F.col("ahead") + F.col("own") - 1).cast("long").alias("slot"), "split")


def shard_ids(docs: DataFrame, shards: int = 16, slots: int = SLOTS, hot_share: float | None = None, map_path: str | None = None, previous: list[int] | None = None, version: int = 1) -> DataFrame:
    """doc_id of every row with size, text_crc32, vslot, shard, slot and split; texts are read once."""
    keyed, keys = row_keyed(docs, "documents")
    slim = stored(sized(keyed, keys), "sizes")
    return planned(slim, shards, slots, hot_share, map_path or scratch_path(docs.sparkSession, "slot-map"), previous, version).drop("row")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, hot_share: float | None = None, map_path: str | None = None, previous: list[int] | None = None, version: int = 1) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, vslot, shard, slot and split.

    Texts are read twice: for sizes and hashes, which are stored and planned from, and for the result.
    """
    keyed, keys = row_keyed(docs.select(*named(without(docs, ADDED))), "documents")
    slim = stored(sized(keyed, keys), "sizes")
    plan = planned(slim, shards, slots, hot_share, map_path or scratch_path(docs.sparkSession, "slot-map"), previous, version)
    return joined_back(keyed, plan.select("row.*", *ADDED), keys)


def op10_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_ids(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "split")


QUERIES = {"op10_shard_slots": op10_shard_slots}
ORACLES: dict[str, str] = {}
