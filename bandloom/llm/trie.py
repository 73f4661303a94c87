"""A prefix trie of conversations, totalled by leaf-peeling message passing.

A node is a distinct sequence of turns from the start. It is named by its depth and by 128 bits of
sums of hashes of (place, role, text), which add up along a conversation: prefixes are running
sums, taken block by block of ``BLOCK`` turns, so a conversation of any length is many tasks' work.

Totals of subtrees are messages from child to parent. Each node hangs on the path of its longest
member (ties: the smallest id), so the nodes with one longest member are a run from somewhere down
to that member's end. A path keeps a counter of child paths that have not reported. Those at zero
are complete: they send their subtree's total to the node they hang on, which lowers the counter
of its path, and leave. Rounds go on until only the root's path is left, and it finishes. Inside a path,
totals are sums from the end, again by blocks. Rounds are at most the number of times that a way from
the root leaves the longest continuation, not the depth: a log of one growing conversation is one path.

The digest of a node's ends is sequential by definition of the hash; ids go to it in slices
of up to 65,536, cut and sorted apart from each other, and memory doesn't grow with them.

Defined results: rows with null conversation id name no conversation and take no part; null role or
text is empty; turns are ordered by number, null first, ties by role and then by the text's MD5;
repeated rows are turns of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import is_empty, ranked, remove_path, scratch_path, stored, temporary, tracked

BLOCK = 1024
SLICE_BITS = 16
GRAFT, CUTS = 5, 9


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, role, mark, bytes): turns in order, texts as their MD5 and length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("mark"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return ranked(turns, "conv_id", ["known", "turn", "role", "mark"], "pos", name="turns").select("conv_id", (F.col("pos") + 1).alias("pos"), "role", "mark", "bytes")


def grafted(turns: DataFrame, every: int = GRAFT, cuts: int = CUTS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: (turns, lengths).

    Conversation c takes the first h turns of conversation c - c % ``every``, h being its
    CRC-32 modulo ``cuts``, and goes on with its own turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % cuts
    heads = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = heads.join(there, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("tail"))
    heads = stored(heads, "heads")
    own = turns.join(heads.select("conv_id", "h", "head"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "role", "mark", "bytes")
    first = turns.where(F.col("pos") < cuts).withColumnRenamed("conv_id", "base")  # the others of a base are fewer than ``every`` on either side of zero
    lent = heads.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("pos <= head").select("conv_id", "pos", "role", "mark", "bytes")
    return own.unionByName(lent), heads.select("conv_id", (F.col("head") + F.col("tail")).alias("len"))


def running(rows: DataFrame, group: list[str], at: str, values: list[str], backwards: bool = False) -> DataFrame:
    """Each of ``values`` as its sum over the group's rows up to ``at`` (or from it on), block by block.

    Blocks' own sums come first; a row adds those of the blocks before its own to its block's.
    """
    rows = rows.withColumn("_block", F.expr(f"{at} div {BLOCK}"))
    toward = F.desc if backwards else F.asc
    ahead = Window.partitionBy(*group).orderBy(toward("_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_block").agg(*[F.sum(v).alias(v) for v in values])
    before = sums.select(*group, "_block", *[F.sum(v).over(ahead).alias(f"_before_{v}") for v in values]).where(F.col(f"_before_{values[0]}").isNotNull())
    inside = Window.partitionBy(*group, "_block").orderBy(toward(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, [*group, "_block"], "left")
    return own.withColumns({v: F.col(v) + F.coalesce(f"_before_{v}", F.lit(0)) for v in values}).drop("_block", *[f"_before_{v}" for v in values])


def _name(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(k), depth, *sums) for k in (1, 2)]


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, len, depth, k1, k2, p1, p2, bytes): a row for each conversation and each prefix of it, the empty one included.

    k names the prefix, p the one a turn shorter.
    """
    pieces = []
    for k in (1, 2):
        h = F.xxhash64(F.lit(k), "pos", "role", "mark")
        pieces += [F.shiftrightunsigned(h, 32).alias(f"a{2 * k - 1}"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"a{2 * k}")]
    rows = turns.select("conv_id", F.col("pos").alias("depth"), "bytes", *pieces)
    names = [f"a{k}" for k in range(1, 5)]
    rows = running(rows.withColumns({f"own_{a}": F.col(a) for a in names}), ["conv_id"], "depth", names)
    here, up = [F.col(a) for a in names], [F.col(a) - F.col(f"own_{a}") for a in names]
    rows = rows.join(lengths, "conv_id")
    (k1, k2), (p1, p2) = _name(F.col("depth"), here), _name(F.col("depth") - 1, up)
    rows = rows.select("conv_id", "len", "depth", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "bytes")
    none = [F.lit(0).cast("long")] * 4
    r1, r2 = _name(none[0], none)
    root = lengths.select("conv_id", "len", none[0].alias("depth"), r1.alias("k1"), r2.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), none[0].alias("bytes"))
    return rows.unionByName(root)


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the ids that end at each node, in numeric order, comma-joined."""
    cut = ends.groupBy("k1", "k2", F.shiftright("conv_id", SLICE_BITS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))  # 65,536 ids at most
    several = cut.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"], strict=True):
                if (k1, k2) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    return several.select("k1", "k2", "ids").mapInPandas(run, "k1 long, k2 long, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """Stored prefixes to nodes, each with its path, its parent's names and its number of children."""
    longest = F.max(F.struct("len", (-F.col("conv_id")).alias("id")))
    own = rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"), longest.alias("l"),
    )
    own = stored(own.withColumn("path", -F.col("l.id")).drop("l"), "nodes")
    kids = own.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    up = own.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    out = own.join(kids, ["k1", "k2"], "left").join(up, ["p1", "p2"], "left")
    return out.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))


def peeled(paths: DataFrame) -> DataFrame:
    """(path, leaves, saved): totals of each path's subtree, from paths (path, up, leaves, saved, remaining) with their own.

    ``remaining`` counts the child paths still to report. A round takes those at zero out, sends their totals
    up and lowers the counters there; what is left is stored, so a round's plan does not hold the rounds before.
    """
    spark = paths.sparkSession
    done = scratch_path(spark, "totals")
    waiting = stored(paths, "waiting")
    while not is_empty(waiting):
        ready = waiting.where("remaining = 0")
        if is_empty(ready):
            raise ArithmeticError("paths without an end")
        ready.select("path", "leaves", "saved").write.mode("append").parquet(done)
        sent = ready.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("n"))
        rest = waiting.where("remaining > 0").join(sent, "path", "left")
        left = [F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("leaves", "l"), ("saved", "s"))]
        before, waiting = waiting, stored(rest.select("path", "up", left[0].alias("leaves"), left[1].alias("saved"), (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining")), "waiting")
        remove_path(spark, before.stored_at)
    return tracked(spark, done, "path long, leaves long, saved long")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, pos from 1 without gaps, role, mark, bytes) of conversations (conv_id, len).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    spark = turns.sparkSession
    with temporary(spark) as keep:
        rows = stored(prefixes(turns, lengths), "prefixes")
        tree = stored(nodes(rows), "tree")
        heads = tree.where("up is null or up <> path")
        own = tree.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = heads.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("remaining"))
        paths = own.join(heads.select("path", "up"), "path").join(below, "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
        got = heads.where("up is not null").select("path", F.col("p1").alias("k1"), F.col("p2").alias("k2")).join(peeled(paths), "path")
        got = got.groupBy("k1", "k2").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        tree = tree.join(got, ["k1", "k2"], "left").withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("leaves", "l"), ("saved", "s"))}).drop("l", "s")
        tree = running(tree, ["path"], "depth", ["leaves", "saved"], backwards=True)
        tree = tree.join(digests(rows.where("depth = len").select("k1", "k2", "conv_id")), ["k1", "k2"], "left")
        return keep(stored(tree.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ), "trie"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary(spark) as keep:
        turns = stored(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
        return keep(prefix_trie(*grafted(turns)))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
crc AS (SELECT list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda a, x: list_reduce(list_concat([xor(a, x)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS r, conv_id FROM c),
h AS (SELECT conv_id, CAST(xor(r, 4294967295::UBIGINT) % 9 AS BIGINT) AS h FROM crc),
b AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN h USING (conv_id) JOIN t ON t.conv_id = base AND t.pos <= h
    UNION ALL SELECT t.conv_id, t.pos - h + least(h, coalesce(n, 0)), role, text FROM t JOIN h USING (conv_id) JOIN c USING (conv_id)
        LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY ALL) USING (base) WHERE t.pos > h),
p AS (SELECT conv_id, pos AS depth, list(struct_pack(role, text)) OVER (PARTITION BY conv_id ORDER BY pos) AS k, strlen(text) AS bytes FROM b
    UNION ALL SELECT conv_id, 0, [], 0 FROM c),
e AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends_sha256 FROM p JOIN e USING (conv_id) GROUP BY k, depth),
u AS (SELECT n.k, n.depth, q.k AS pk FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
kids AS (SELECT pk AS k, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY pk),
below AS (SELECT p.k, p.depth, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved_tokens
    FROM p JOIN n m ON m.conv_id = p.conv_id AND m.depth >= p.depth LEFT JOIN kids ON kids.k = m.k GROUP BY p.k, p.depth)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.k = n.k JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN n up ON n.depth > 0 AND up.k = u.pk
"""
}
