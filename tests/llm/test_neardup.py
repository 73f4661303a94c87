"""Chosen-path components against all pairs by brute force."""

from __future__ import annotations

import random
import re

import numpy as np

from bandloom.llm import neardup as N


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, per_cent=85):
    """[(doc_id, n_shingles, component_id)] with a union over all pairs of sets."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    keys = [k for k in sets if k]
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if both and 100 * both >= per_cent * (len(keys[a]) + len(keys[b]) - both):
                up[root(a)] = root(b)
    ids = {}
    for k, key in enumerate(keys):
        ids.setdefault(root(k), []).extend(i for i in sets[key] if i is not None)
    name = {key: min(ids[root(k)], default=None) for k, key in enumerate(keys)}
    return sorted(((i, len(shingles(t)), name.get(shingles(t), i)) for i, t in rows), key=str)


def got(df, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df, **how).collect()), key=str)


def test_small_table_equals_brute_force(small_docs):
    rows = [tuple(r) for r in small_docs.select("doc_id", "text").collect()]
    assert got(small_docs) == brute(rows)


def test_groups_chains_and_shared_passages(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz") + str(rng.randint(0, 99))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(250):  # one large group of near copies, some at the edge of the threshold
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(200)] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(120)]
    for k in range(40):  # a chain: neighbours link, ends do not
        texts.append(" ".join(chain))
        chain[3 * k % 120] = word()
    passage = " ".join(base[:60])
    texts += [passage + " " + " ".join(word() for _ in range(80)) for _ in range(60)]
    texts += ["One two three.", "one TWO three.", "one two", "", None, " \n", "a b c d e f g", "a b c d e f g h"] + texts[:5]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three."), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert got(df) == want
    assert got(df, leaf=16, depth=2) == want


def test_deduplicated_keeps_one_of_each_component_and_all_columns(odd_docs, empty_docs):
    near = {(r.doc_id, r.component_id) for r in N.near_duplicates(odd_docs).collect()}
    stay = N.deduplicated(odd_docs)
    assert stay.columns == odd_docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, c in near}
    assert N.near_duplicates(empty_docs).count() == 0 and N.deduplicated(empty_docs).count() == 0


def test_deduplicated_with_null_and_repeated_ids(spark):
    word = [f"w{k}" for k in range(300)]
    near = lambda a, k: " ".join([*word[a : a + 100], f"own{k}"])
    rows = [(7, near(0, k)) for k in range(3)] + [(7, near(0, 1)), (9, near(0, 9)), (None, near(0, 8))]
    rows += [(None, near(100, k)) for k in range(3)] + [(None, near(200, 0))] * 2 + [(5, "")] * 2 + [(None, None)] * 2 + [(5, " \n"), (7, "a text of its own here")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long").repartition(5)
    assert len({r.component_id for r in N.near_duplicates(df.where("n < 6")).collect()}) == 1
    stay = [(r.doc_id, r.text) for r in N.deduplicated(df).collect()]
    about = lambda a: [i for i, t in stay if t and t.startswith(word[a] + " ")]
    assert about(0) == [7] and about(100) == [None] and about(200) == [None]
    rest = [x for x in stay if not (x[1] or "").startswith("w")]
    assert sorted(rest, key=str) == sorted(rows[11:], key=str)


def test_components_of_a_long_path(spark):
    n = 70
    key = lambda k: np.array([k * 7919 % 71], ">u8").tobytes()
    links = spark.createDataFrame([(bytearray(key(k)), bytearray(key(k + 1))) for k in range(n - 1)], "a binary, b binary")
    assert {bytes(r.root) for r in N.components(links).collect()} == {min(key(k) for k in range(n))}


def test_links_that_fail_put_their_classes_in_doubt(spark):
    """Where nodes take pairs far below the threshold for links, many fail, and the true links must still be found."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for g in range(6):
        for _ in range(12):
            t = [f"{w}{g // 2}" for w in base]
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(100)] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, trees=4, margin=-15) == brute(rows)


def test_recall_of_links_at_and_just_above_the_threshold(spark):
    """10,000 rows, 600 planted pairs between 85 and 87 per cent, as many just below, all under passages that many share."""
    rng = random.Random(11)
    fresh = iter(range(10**9))
    word = lambda: f"u{next(fresh)}"
    shared = [[word() for _ in range(30)] for _ in range(12)]
    texts, links = [], set()
    for p in range(1200):
        # a run of x new words at the end of one text: n - x common shingles of n + x
        n, near = rng.randint(80, 300), p < 600
        x = int(n * 15 / 185) if near else int(n * 15 / 185) + 1
        a = [*shared[p % 12], *(word() for _ in range(n + 4 - 30))]
        b = [*a[: len(a) - x], *(word() for _ in range(x))]
        both = len(set(shingles(" ".join(a))) & shingles(" ".join(b)))
        assert (100 * both >= 85 * (2 * n - both)) == near
        if near:
            links.add((len(texts), len(texts) + 1))
        texts += [" ".join(a), " ".join(b)]
    while len(texts) < 10_000:
        texts.append(" ".join([*shared[len(texts) % 12], *(word() for _ in range(rng.randint(31, 90)))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {(c, i) for i, _, c in got(df) if c != i}
    assert not found - links  # a link that is none
    assert len(found) >= 0.995 * len(links)
