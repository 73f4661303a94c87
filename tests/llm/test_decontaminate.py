"""Suffix-automaton matches against brute-force windows."""

from __future__ import annotations

import hashlib
import random
import re

from bandloom.llm import decontaminate as D

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    """doc -> (n_words, n_hit, items, digest, contaminated)"""
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i) if i is not None else "")
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= got
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    m = D.matches(df[0], df[1], ["doc_id"], **(df[2] if len(df) > 2 else {}))
    out = m.withColumn("bad", D.contaminated()).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.bad) for r in out], key=str)


def fuzz(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abAB1") for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 20, 30]))) for i in range(12)] + [(None, text(15)), (3, text(16)), (50, None), (51, "--- ,")]
    docs = [(i, text(rng.randint(0, 60)) if i % 3 else "zz " + (items[i % 12][1] or "") + " q " + text(9)) for i in range(120)] + [(500, None), (501, ""), (501, "A a")]
    return docs, items


def test_fuzz_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = fuzz(seed)
        items = [x for x in items if x[0] is None or x[1] is None or len(words(x[1])) not in (1, 2)] if seed == 2 else items
        d = spark.createDataFrame(docs, "doc_id long, text string")
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert rows((d, b)) == want
        assert rows((d, b, {"block_words": 30})) == want  # several blocks
        assert rows((d, b, {"piece_words": 15})) == want  # long items in pieces


def test_whole_small_table_equals_brute_force(small_docs, spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([tuple(r) for r in small_docs.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()])
    assert rows((small_docs, b)) == want and any(x[5] for x in want)


def test_odd_tables_and_cuts(spark, odd_docs, empty_docs, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert D.matches(odd_docs, b, ["doc_id", "source", "kept", "size"]).count() == odd_docs.count()
    assert D.matches(empty_docs, b, ["doc_id"]).count() == 0
    assert {r.n_hit for r in D.matches(odd_docs, b.limit(0), ["doc_id"]).collect()} == {0}
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, "pad " * 400 + item.upper() + " Ende é."), (2, item), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), cut_length=13).collect()}
    assert got == {1: "pad " * 400 + " Ende é.", 3: None}


def test_texts_stay_where_they_are_with_several_blocks(spark, sf_dir):
    """The join of a plan of several blocks exchanges ids and keys only."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = D.found(docs, bench, "f", block_words=300).select("doc_id", "f")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :].split("\n")
    below = next(line for line in join[1:] if "Project" in line)
    assert "regexp_extract_all" in below and "text#" not in below.replace("translate(text#", "translate(")
    want = {r.doc_id: r.f for r in D.found(docs, bench, "f").select("doc_id", "f").collect()}
    assert {r.doc_id: r.f for r in out.collect()} == want
