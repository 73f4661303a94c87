"""Every stage of the pipeline against brute force over what the stage before it kept; mixing and sharding on odd tables."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import corpus_pipeline as P
import pytest
from bandloom.llm import decontaminate, langid, mixing, pii, quality, sharding
from pyspark.sql import functions as F
from bandloom.llm.shared import stored

from .test_decontaminate import brute as contaminated_brute
from .test_neardup import brute as near_brute
from .test_row_operators import quality_brute


def good(t):
    n, chars, symbols, dup, repeat = quality_brute(t)
    lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r"))
    return n >= 50 and 2 * repeat <= n and 2 * n <= chars <= 15 * n and 10 * symbols <= 3 * n and 2 * dup <= lines


def mixed_brute(rows):
    """Words taken of each source and its target, from targets filled level by level."""
    size = Counter()
    for _, t, _, source, _ in rows:
        size[source] += quality_brute(t)[0]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return size, target


def check_mixed(before, after):
    size, target = mixed_brute(before)
    longest = Counter()
    for _, t, _, source, _ in before:
        longest[source] = max(longest[source], quality_brute(t)[0])
    taken, copies = Counter(), Counter(after)
    for row, n in Counter(before).items():
        assert copies[row] <= 2 * n
    for (_, t, _, source, _), n in copies.items():
        taken[source] += n * quality_brute(t)[0]
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 * longest[s] + 1


def check_sharded(before, after, shards):
    assert Counter(tuple(r[:5]) for r in after) == Counter(before)
    by = {}
    for r in after:
        assert r.size == len((r.text or "").encode()) + 1
        assert r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode()))
        by.setdefault(r.shard, []).append(r)
    total, longest = sum(r.size for r in after), max(r.size for r in after)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / shards) <= max(2 * longest, 0.02 * total / shards)


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, sf_dir), "test")
        got = out.collect()
        if name == "quality_rules":
            want = [r for r in rows if good(r[1])]
        elif name == "near_dedup":
            keep = {i for i, _, c in near_brute([r[:2] for r in rows], P.SIMILARITY) if i == c}
            want = [r for r in rows if r[0] in keep]
        elif name == "decontamination":
            bad = {x[0] for x in contaminated_brute([r[:2] for r in rows], bench) if x[5]}
            want = [r for r in rows if r[0] not in bad]
        if name in ("quality_rules", "near_dedup", "decontamination"):
            assert out.columns == columns and Counter(map(tuple, got)) == Counter(want) and 0 < len(want) < len(rows)
        elif name == "mixing":
            assert out.columns == columns
            check_mixed(rows, [tuple(r) for r in got])
        else:
            check_sharded(rows, got, P.SHARDS)
        docs, rows = out, [tuple(r[:5]) for r in got]


def test_stages_take_odd_and_empty_tables(spark, odd_docs, empty_docs, sf_dir):
    for start in (odd_docs, empty_docs):
        docs = start
        for _, stage in P.STAGES:
            docs = stored(stage(spark, docs, sf_dir), "odd")
            assert docs.columns == start.columns or "shard" in docs.columns


def test_mixing_odd_tables(spark, odd_docs, empty_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, 0) for r in odd_docs.collect()]
    m = mixing.mix(odd_docs).collect()
    assert len(m) == len(rows) and m == mixing.mix(odd_docs).collect() or sorted(map(str, m)) == sorted(map(str, mixing.mix(odd_docs).collect()))
    check_mixed(rows, [(r.doc_id, r.text, r.lang, r.source, 0) for r in m for _ in range(r.copies)])
    assert mixing.mix(empty_docs).count() == 0


def test_sharding_odd_tables_hot_texts_and_rebalancing(spark, odd_docs, empty_docs):
    cols = ["doc_id", "text", "lang", "source", "kept"]
    out = sharding.shard(odd_docs.select(*cols), 4)
    # one text of 200,000 bytes and one of 150,000 outweigh any shard: only order and wholeness can hold
    got = out.collect()
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(tuple(r[c] for c in cols) for r in odd_docs.collect())
    assert sharding.shard(empty_docs, 4).count() == 0
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 50), concat('doc ', id, repeat(' x', 90))) as text", "'en' as lang", "'a' as source", "id % 7 as kept")
    rows = sharding.shard(hot, 8, hot_share=0.9).select(*cols, "size", "text_crc32", "vslot", "shard", "slot").collect()
    check_sharded([tuple(r) for r in hot.select(*cols).collect()], rows, 8)
    ids = sharding.shard_ids(hot, 8, hot_share=0.9)
    assert "text" not in ids.columns and {(r.doc_id, r.size, r.text_crc32, r.vslot, r.shard, r.slot) for r in ids.collect()} == {(r.doc_id, r.size, r.text_crc32, r.vslot, r.shard, r.slot) for r in rows}
    assert sharding.shard_ids(empty_docs, 4).count() == 0 and sharding.shard_ids(odd_docs, 4).count() == odd_docs.count()


def test_rebalancing_moves_few_slots():
    weights = {k: 100 + k % 17 for k in range(4096)}
    first = sharding.balanced(weights, 16, 4096)
    grown = sharding.rebalanced(first, weights, 17)
    moved = [k for k in range(4096) if first[k] != grown[k]]
    assert all(grown[k] == 16 for k in moved) and 4096 / 17 * 0.85 < len(moved) < 4096 / 17 + 12
    load = Counter()
    for k, s in enumerate(grown):
        load[s] += weights[k]
    assert max(load.values()) / min(load.values()) < 1.06
    assert sharding.rebalanced(first, weights, 16) == first


#: Names that the operators use themselves, or add.
NAMES = """_text _own _copy _ahead _rank _s _source _again _times _file _place _verdict _found _hits _said _metadata _at _part _tie _n _first _p _g _shift
row own ahead copy n key mark file place sub subs part anon h at words texts vslot shard slot size text_crc32 split kept rejected_by n_words n_hit spans items longest copies target
source_size pii doubt word_chars base_failed lang_pred score accepted path blob a.b c`d""".split()


def test_columns_of_any_name_come_through(spark, small_docs, sf_dir):
    docs = small_docs.select("doc_id", "text", "source", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in NAMES])
    for many, stages in ((docs, P.STAGES), (docs.repartition(3), P.STAGES[3:])):  # the second is stored first
        for name, stage in stages:
            out = stage(spark, many, sf_dir)
            added = [c for c in NAMES if c in sharding.ADDED] if name == "sharding" else []
            assert [c for c in out.columns if c not in sharding.ADDED] == [c for c in docs.columns if c not in added] if added else out.columns == docs.columns
            for r in out.limit(20).collect():
                assert all(r[c] == f"{c} {r.doc_id}" for c in NAMES if c not in added)
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = [c for c in NAMES if c not in ("kept", "rejected_by", "size", "source_size", "target", "copies", "n_words", "n_hit", "spans", "items", "longest", "lang_pred", "score", "accepted", "pii")]
    outs = [quality.cascade(docs), mixing.mix(docs), decontaminate.matches(docs, b, docs.columns), langid.predict(docs, {"en": b"the of"}, docs.columns), pii.find(docs)]
    for out in outs:
        r = out.first()
        assert len(set(out.columns)) == len(out.columns) and all(r[c] == f"{c} {r.doc_id}" for c in kept)


def test_the_map_is_written_once(spark, tmp_path):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('text ', id % 100, repeat('x', cast(id % 100 as int)))  as text")
    at = f"file://{tmp_path}/map"
    first = sharding.shard_ids(docs, 4, map_path=at)
    assert first.count() == 400 and sharding.shard_ids(docs, 4, map_path=at).count() == 400
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, sharding.shard_ids(docs, 4, map_path=at).collect()))
    with pytest.raises(ValueError, match="version 1"):
        sharding.shard_ids(docs.where("doc_id < 300"), 4, map_path=at)
    os.remove(f"{tmp_path}/map/version=1/_SUCCESS")  # as an interrupted run leaves it
    assert sharding.shard_ids(docs, 4, map_path=at).count() == 400
    previous = [r.shard for r in spark.read.parquet(f"{at}/version=1").orderBy("vslot").collect()]
    grown = sharding.shard_ids(docs, 5, map_path=at, previous=previous, version=2)
    before = {r.doc_id: r.shard for r in first.collect()}
    moved = [r for r in grown.collect() if r.shard != before[r.doc_id]]
    assert 4 in {r.shard for r in moved} and len(moved) < 200 and len(before) == grown.count()


def test_copies_share_a_shard_unless_they_are_marked(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 40), concat('doc ', id % 500, repeat(' y', 60))) as text")
    whole = sharding.shard(docs, 8).collect()
    homes: dict = {}
    for r in whole:
        homes.setdefault(r.text, set()).add(r.shard)
    assert not any(r.split for r in whole) and all(len(v) == 1 for v in homes.values())
    for k in range(8):
        assert sorted(r.slot for r in whole if r.shard == k) == list(range(sum(r.shard == k for r in whole)))
    assert {(r.doc_id, r.shard) for r in whole} == independent_plan([(r.doc_id, r.text) for r in whole], {(r.text, r.doc_id): r.vslot for r in whole}, 8)
    rows = sharding.shard(docs, 8, hot_share=0.9).collect()
    by = {}
    for r in rows:
        by.setdefault((r.text, r.split), set()).add((r.shard, r.vslot))
    assert all(len(v) == 1 for (_, split), v in by.items() if not split)
    assert {t for t, split in by if split} == {"hot " * 40} and not any((t, False) in by for t, split in by if split)
    want = independent_plan([(r.doc_id, r.text) for r in rows], {(r.text, r.doc_id): r.vslot for r in rows}, 8)
    assert {(r.doc_id, r.shard) for r in rows} == want


def independent_plan(rows, vslot, shards):
    """Slots by weight, heaviest first, each to the shard that has least, then fewest slots, then the lowest number."""
    weight = Counter()
    for i, t in rows:
        weight[vslot[t, i]] += len(t.encode()) + 1
    load, held, home = [0] * shards, [0] * shards, {}
    for slot in sorted(range(sharding.SLOTS), key=lambda k: (-weight[k], k)):
        s = min(range(shards), key=lambda k: (load[k], held[k], k))
        load[s], held[s], home[slot] = load[s] + weight[slot], held[s] + 1, s
    return {(i, home[vslot[t, i]]) for i, t in rows}


def test_mixing_does_not_depend_on_the_layout(spark, tmp_path):
    rows = [(None if k % 2 else 7, f"w{k} x y", ["a", "b", None][k % 3], {"k": k}) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    outs = []
    for n in (1, 7):
        df.repartition(n, "text").write.parquet(f"file://{tmp_path}/{n}")
        outs.append(sorted(map(str, mixing.repeated(spark.read.parquet(f"file://{tmp_path}/{n}")).select("doc_id", "text", "source").collect())))
    assert outs[0] == outs[1] and 600 < len(outs[0]) < 1800


def test_scopes_of_temporary_tables(spark, tmp_path):
    from bandloom.llm.shared import path_exists, stored, temporary

    with pytest.raises(ZeroDivisionError), temporary(spark):
        with temporary(spark):
            pass  # an empty scope inside another
        a = stored(spark.range(3), "a")
        with pytest.raises(KeyError), temporary(spark):
            raise KeyError("before anything is stored")
        with temporary(spark) as keep:
            b, c = keep(stored(spark.range(4), "b")), stored(spark.range(5), "c")
        assert b.count() == 4 and not path_exists(spark, c.stored_at)
        1 / 0
    assert not path_exists(spark, a.stored_at) and not path_exists(spark, b.stored_at)
