"""Quality rules as a short-circuit cascade.

A rule reads some measures of a text and rejects or passes it. On a sample (of a stated
size, drawn over the whole table) every rule's cost is timed and its rejection rate counted;
rules then run in order of rejections per cost, and a text that one rule rejects is not
measured for the next. The order changes the work only: a text is kept if no rule rejects it.

Defined results: null text has no words and is rejected for its length; repeated rows are
rows of their own; an empty table gives an empty result and the listed order of rules; extra
columns pass through (columns named as those added are replaced).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, fresh, hash_words, mix, named, text_udf, without, words_of

U64 = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FIRST_BYTE = np.array([(b & 0xC0) != 0x80 for b in range(256)])


class Text:
    """One text's measures, each worked out when first asked for."""

    def __init__(self, data: bytes):
        self.data = data
        self.buf = np.frombuffer(data, np.uint8)
        self._got: dict[str, object] = {}

    def __getattr__(self, name: str):
        make = MEASURES.get(name)
        if make is None:
            raise AttributeError(name)
        if name not in self._got:
            self._got[name] = make(self)
        return self._got[name]


def _repeat_words(t: Text) -> int:
    """Words in 3-word windows found twice or more in the text, the first included."""
    h = hash_words(t.buf, *t.words)
    if len(h) < 4:
        return 0
    tri = mix(h[:-2] * U64(3) + mix(h[1:-1]) * U64(5) + mix(mix(h[2:])) * U64(7))
    _, where, n = np.unique(tri, return_inverse=True, return_counts=True)
    again = n[where] > 1
    hit = np.zeros(len(h), bool)
    for k in range(3):
        hit[k : len(h) - 2 + k] |= again
    return int(hit.sum())


def _dup_lines(t: Text) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in t.data.split(b"\n") if x.strip(b" \t\v\f\r")]
    return len(lines) - len(set(lines))


#: n_lines: lines with a word
MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: words_of(t.buf),
    "n_words": lambda t: len(t.words[0]),
    "word_chars": lambda t: int((FIRST_BYTE[t.buf] & ~SPACE[t.buf]).sum()),
    "n_symbols": lambda t: int(SYMBOLS[t.buf].sum()),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda t: sum(1 for x in t.data.split(b"\n") if x.strip(b" \t\v\f\r")),
    "n_repeat_words": _repeat_words,
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Fixed limits. The first two decide base_failed; the others are the method's own.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 5 * t.n_lines),
)
BASE = ("few_words", "repeated_words")


SAMPLE_CHARS = 20_000


def sampled(docs: DataFrame, size: int, seed: int = 11) -> list[bytes]:
    """About ``size`` texts drawn over all rows: a Bernoulli sample, of which no more than twice the size is fetched,
    and of each text the first ``SAMPLE_CHARS`` characters. It decides the order of rules only."""
    n = docs.count()
    if not n:
        return []
    rows = docs.select(F.substring("text", 1, SAMPLE_CHARS)).sample(fraction=min(1.0, size / n), seed=seed).limit(2 * size).collect()
    return [(r[0] or "").encode() for r in rows]


def rule_order(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Rules by rejections per second of cost on the sample, highest first; ties and no sample: as listed.

    The words of a text, which most rules share, are split beforehand, as in the cascade only the first rule pays for them.
    """
    if not sample:
        return [r.name for r in rules]
    worth = []
    for k, rule in enumerate(rules):
        texts = [Text(x) for x in sample]
        for t in texts:
            _ = t.words
        began = time.perf_counter()
        rejected = sum(rule.rejects(t) for t in texts)
        cost = max(time.perf_counter() - began, 1e-9)
        worth.append((-rejected / len(sample) / cost, k, rule.name))
    return [name for _, _, name in sorted(worth)]


def verdicts(texts: Iterator[list[bytes | None]], order: list[str], measure_all: bool) -> Iterator[list[dict]]:
    rules = {r.name: r for r in RULES}
    for batch in texts:
        out = []
        for data in batch:
            t = Text(data or b"")
            by = next((name for name in order if rules[name].rejects(t)), None)
            out.append({"kept": by is None, "rejected_by": by})
            if measure_all:
                out[-1] |= {k: getattr(t, k) for k in REPORTED} | {"base_failed": any(rules[k].rejects(t) for k in BASE)}
        yield out


MEASURED = ("kept boolean", "rejected_by string", *(f"{k} long" for k in REPORTED), "base_failed boolean")


def cascade(docs: DataFrame, columns: list[str] | None = None, measure_all: bool = False, only_kept: bool = False, sample_size: int = 500) -> DataFrame:
    """``columns`` of ``docs`` (all, if None) with ``kept`` and ``rejected_by`` (the first rule that rejected, or null).

    ``measure_all`` adds every measure and ``base_failed``, which a short-circuit run leaves
    out; ``only_kept`` returns the rows that pass.
    """
    spec = MEASURED if measure_all else MEASURED[:2]
    added = [c.split()[0] for c in spec]
    order = rule_order(sampled(docs, sample_size))
    verdict = text_udf(lambda texts: verdicts(texts, order, measure_all), f"struct<{', '.join(c.replace(' ', ': ') for c in spec)}>")
    own = fresh(docs, "_verdict")
    columns = [c for c in without(docs, added) if columns is None or c in columns]
    out = docs.withColumn(own, verdict("text"))
    return (out.where(F.col(own)["kept"]) if only_kept else out).select(*named(columns), f"{own}.*")


def passing(docs: DataFrame, sample_size: int = 500) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with its columns as they are."""
    order = rule_order(sampled(docs, sample_size))
    return docs.where(text_udf(lambda texts: ([v["kept"] for v in batch] for batch in verdicts(texts, order, False)), "boolean")("text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = cascade(docs, ["doc_id"], measure_all=True)
    return out.select("doc_id", *REPORTED, "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
