"""Katz scores against a plain dictionary model of the same definition; probabilities sum to one."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from bandloom.llm import katz

END = "\x00end"


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), END]


def spectrum(counts):
    n = Counter(counts.values())
    return [float(n[r]) for r in range(1, katz.K + 2)]


def out_of_fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2


class Brute:
    def __init__(self, rows):
        self.uni, self.bi = Counter(), Counter()
        for i, t in rows:
            if out_of_fold(i):
                w = tokens(t)
                self.uni.update(w)
                self.bi.update(zip([None, *w], w, strict=False))
        self.n = sum(self.uni.values())
        d1, d2 = katz.discounts(spectrum(self.uni)), katz.discounts(spectrum(self.bi))
        d = lambda c, ds: ds[c - 1] if c <= katz.K else 1.0
        freed = sum((1 - d(c, d1)) * c for c in self.uni.values()) / self.n
        self.unk = max(freed, 1 / (self.n + 1))
        self.p1 = {w: (1 - self.unk) / (1 - freed) * d(c, d1) * c / self.n for w, c in self.uni.items()}
        follow = defaultdict(dict)
        for (v, w), c in self.bi.items():
            follow[v][w] = c
        self.p2, self.alpha = {}, {}
        for v, ws in follow.items():
            total = sum(ws.values())
            freed = sum((1 - d(c, d2)) * c for c in ws.values()) / total
            left = max(freed, 1 / (total + 1))
            self.p2[v] = {w: (1 - left) / (1 - freed) * d(c, d2) * c / total for w, c in ws.items()}
            self.alpha[v] = left / (1 - sum(self.p1[w] for w in ws))

    def p(self, v, w):
        low = self.p1.get(w, self.unk)
        if v not in self.p2 or (v is not None and v not in self.uni):
            return low
        return self.p2[v].get(w, self.alpha[v] * low)

    def score(self, t):
        w = tokens(t)
        base = sum(math.log10((self.uni[x] + 1) / (self.n + len(self.uni) + 1)) for x in w)
        return len(w), sum(x in self.uni for x in w), base, sum(math.log10(self.p(v, x)) for v, x in zip([None, *w], w, strict=False))


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3000, "bucket": 1500}])
def test_scores_equal_brute_force(spark, small_docs, odd_docs, sizes):
    docs = small_docs.select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 1000000", "text"))
    rows = [tuple(r) for r in docs.collect()]
    model = Brute(rows)
    for v in [None, "the", END, "of", "señor"]:
        if v in model.p2:
            assert sum(model.p(v, w) for w in model.uni) + model.p(v, "\x00unknown") == pytest.approx(1, abs=1e-9)
    want = sorted(((i, not out_of_fold(i), *model.score(t)) for i, t in rows), key=lambda x: (str(x[0]), x[2:]))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in katz.train_and_score(docs, **sizes).collect()), key=lambda x: (str(x[0]), x[2:]))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)
    held = [x for x in want if x[1] and x[2] > 20]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)


def test_empty_and_untrained_tables(spark, empty_docs):
    assert katz.train_and_score(empty_docs).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if not out_of_fold(i)], "doc_id long, text string")
    rows = katz.train_and_score(only_held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in rows)


def test_buckets_without_words(spark):
    rows = [(k, t) for k, t in enumerate(["a b a", "b c", None, "a b d"])]
    model = Brute(rows)
    got = {r.doc_id: r.score for r in katz.train_and_score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), chunk=6, bucket=1).collect()}
    assert got == {i: pytest.approx(model.score(t)[3]) for i, t in rows}


@pytest.mark.parametrize("parts, sizes", [(1, {}), (40, {"chunk": 1, "bucket": 1 << 20}), (40, {"chunk": 1, "bucket": 50})])
def test_layout_of_rows_does_not_matter(spark, parts, sizes):
    """Held-out documents in chunks of their own, with contexts that only unknown words follow, among contexts of all weights."""
    rows = [(k, " ".join(f"w{(k * j) % (7 + j)}" for j in range(1, 90))) for k in range(300)]
    rows += [(1000 + k, f"w{k % 9} zzz{k} w{k % 5} q") for k in range(40)] + [(2000 + k, "w7 zzz") for k in range(40)]
    model = Brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    got = {r.doc_id: r.score for r in katz.train_and_score(docs, **sizes).collect()}
    assert got == {i: pytest.approx(model.score(t)[3], abs=1e-9) for i, t in rows}


def test_arrays_survive_packing():
    import numpy as np

    for a in (np.zeros(0, np.uint64), np.array([3, 9, 2**63], np.uint64), np.arange(1000, dtype=np.uint32)):
        assert (katz.unpack(katz.pack(a, True), a.dtype, True) == a).all() and (katz.unpack(katz.pack(a), a.dtype) == a).all()
