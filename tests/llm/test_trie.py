"""The prefix trie against a dictionary of tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bandloom.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    members, made = defaultdict(set), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].add(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if made[c] == k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df) -> list[tuple]:
    return sorted([tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(*trie.grafted(trie.numbered(df))).collect()], key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth int, len string"


def odd_conversations() -> list[tuple]:
    """Common openings, growing logs, ties, nulls, repeats, gaps, negative and huge ids, one long conversation."""
    rng = random.Random(4)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, ["user", "assistant", None][t % 3], rng.choice(["hi", "", None, "ño", f"own {c}"]), 1, "x"))
    for c in range(200, 260):
        rows += [(c, t, "user", f"log {t}", 1, "x") for t in range(c - 199)]
    rows += [(-k, t, "user", f"neg {t % 2}", 1, "x") for k in range(1, 14) for t in range(k)]
    rows += [(2**62 + k, None if t < 2 else 5, "a", rng.choice("pq"), 1, "x") for k in range(6) for t in range(6)]
    rows += [(400, t, "user", f"long {t}", 1, "x") for t in range(3000)] + [(401, t, "user", f"long {t}", 1, "x") for t in range(2500)]
    return [*rows, *rows[:5], (None, 1, "user", "nobody", 1, "x"), (70_000, 1, "user", "far", 1, "x"), (140_000, 1, "user", "far", 1, "x")]


def test_trie_equals_brute_force(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows)
    assert max(r[1] for r in want) > 2 * trie.BLOCK and built(df) == want


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert built(df) == [] and built(spark.createDataFrame([(None, 1, "u", "t", 1, "x")], SCHEMA)) == []
    one = [(3, 1, "u", "t", 1, "x")]
    assert zlib.crc32(b"3") % 9 and built(spark.createDataFrame(one, SCHEMA)) == brute(one)


@pytest.mark.parametrize("block", [1, 3])
def test_running_sums_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    df = spark.range(1, 21).select((F.col("id") % 2).alias("g"), F.col("id").alias("at"), F.col("id").alias("v"))
    up = {r.at: r.v for r in trie.running(df, ["g"], "at", ["v"]).collect()}
    down = {r.at: r.v for r in trie.running(df, ["g"], "at", ["v"], backwards=True).collect()}
    assert up == {k: sum(j for j in range(1, k + 1) if j % 2 == k % 2) for k in range(1, 21)}
    assert down == {k: sum(j for j in range(k, 21) if j % 2 == k % 2) for k in range(1, 21)}


def test_a_comb_peels_round_by_round(spark):
    """A chain of paths: each waits for the one that hangs on it."""
    paths = spark.createDataFrame([(k, k - 1 if k else None, 1, 10, 1 if k < 6 else 0) for k in range(7)], "path long, up long, leaves long, saved long, remaining long")
    assert {r.path: (r.leaves, r.saved) for r in trie.peeled(paths).collect()} == {k: (7 - k, 10 * (7 - k)) for k in range(7)}


def test_digest_of_many_ends(spark):
    ids = [*range(-3, 200), *range(65_530, 65_540), 10**12]
    df = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 9)], "k1 long, k2 long, conv_id long").repartition(5)
    got = {(r.k1, r.k2): r.ends_sha256 for r in trie.digests(df).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"9").hexdigest()}
