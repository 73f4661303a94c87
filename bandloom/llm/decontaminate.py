"""Benchmark decontamination with a generalised suffix automaton over words.

Test items are normalised to words and built, one after another, into one suffix automaton.
A document's words are streamed through it; after each word the length of the longest match
that ends there is known. A match of ``window`` words or more, or a whole item that is
shorter, marks the words it covers. A document is contaminated when the marked words reach
``coverage`` of its words; spans can also be cut out of the text.

The automaton holds each distinct text once, whatever number of items share it; items are
named afterwards, once for each set of texts that documents meet, by a join. A long text is cut
into pieces that overlap by a window less one word, so that every window is in one of them.
Pieces are dealt by hash into blocks of about ``block_words`` words. One block at a time is
broadcast and built into an automaton in the workers. A benchmark of one block takes one
pass of the documents; each further block takes another, which stores the rows that it hits, so
more blocks mean more passes and not more memory.

Defined results: null text has no words and no hits; a null or wordless item matches nothing;
items with equal text each count; items with one id count once, a null id as the empty string;
repeated document rows are rows of their own; empty tables give no hits or no rows; extra
columns pass through (``columns`` of :func:`matches`), and are replaced where they clash.
``longest`` counts words of one piece.
"""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, joined_back, named, row_keyed, stored, temporary, text_udf, without

#: Fixed value: a word, over UTF-8 bytes with A-Z lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BLOCK_WORDS = 100_000
PIECE_WORDS = 10_000


class SuffixAutomaton:
    """Of word sequences; each state knows the items whose window, or whole short text, it stands for."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: items by the state of a window, and by (state, length) of a short item
        self.window_items: list[set[str] | None] = [None] * len(self.link)
        self.short_items: dict[int, list[tuple[int, set[str]]]] = {}
        for item, words in items:
            if not words:
                continue
            state = 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= window:
                    at = self.ancestor(state, window)
                    if self.window_items[at] is None:
                        self.window_items[at] = set()
                    self.window_items[at].add(item)
            if len(words) < window:
                at = self.ancestor(state, len(words))
                found = self.short_items.setdefault(at, [])
                for n, ids in found:
                    if n == len(words):
                        ids.add(item)
                        break
                else:
                    found.append((len(words), {item}))
        #: the nearest state, itself or up the links, that short items end at; 0: none
        self.short_up = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short_up[s] = s if s in self.short_items else self.short_up[self.link[s]]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # a later item walks what is there
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def ancestor(self, state: int, n: int) -> int:
        """The state of the length-``n`` suffix of ``state``'s longest word sequence."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Covered spans (word offsets, end exclusive, merged), the items met, the longest match."""
        nxt, link, length, window, up = self.next, self.link, self.length, self.window, self.short_up
        root = nxt[0]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = n = longest = 0
        here = root
        for i, w in enumerate(words):
            to = here.get(w)
            if to is None:
                if state:
                    while state and w not in nxt[state]:
                        state = link[state]
                    n = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    state = n = 0
                    here = root
                    continue
            state, n = to, n + 1
            here = nxt[to]
            if n > longest:
                longest = n
            if n >= window:
                spans.append((i + 1 - n, i + 1))
                items |= self.window_items[self.ancestor(state, window)]
            s = up[state]
            while s:
                for k, ids in self.short_items[s]:
                    if k <= n:
                        spans.append((i + 1 - k, i + 1))
                        items |= ids
                s = up[link[s]]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                if b > merged[-1][1]:
                    merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        return merged, items, longest


# ---------------------------------------------------------------- the benchmark as texts


def words_column(text: str = "text") -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD_SQL), F.lit(0))


def item_texts(benchmark: DataFrame) -> DataFrame:
    """(item, key, words) of the items that have words; equal texts have one key."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_column().alias("words")).where(F.size("words") > 0)
    return items.select("item", F.xxhash64(F.array_join("words", " ")).alias("key"), "words")


def pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(key, words, block hash): distinct texts, cut where they are long."""
    step = max(1, piece_words - window + 1)
    texts = item_texts(benchmark).groupBy("key").agg(F.first("words").alias("words"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step)))
    cut = texts.select("key", "words", at.alias("at"))
    return cut.select("key", F.when(F.size("words") <= piece_words, F.col("words")).otherwise(F.slice("words", F.col("at") + 1, F.lit(piece_words))).alias("words"), F.xxhash64("key", "at").alias("h"))


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, block, window: int) -> SuffixAutomaton:
    if key not in _built:
        _built.clear()  # a worker holds one block's automaton at a time
        _built[key] = SuffixAutomaton([(k, t.split(b" ")) for k, t in block.value], window)
    return _built[key]


# ---------------------------------------------------------------- documents against blocks

FOUND = "struct<n_words: bigint, n_hit: bigint, spans: array<struct<start: int, end: int>>, texts: array<bigint>, longest: int>"


def search(spark: SparkSession, block: list[tuple[int, bytes]], window: int) -> Column:
    """What a document's text has of a block of (key, words joined by spaces)."""
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(texts: Iterator[list[bytes | None]]) -> Iterator[list[dict]]:
        sa = _automaton(key, shared, window)
        for batch in texts:
            out = []
            for data in batch:
                words = WORD.findall((data or b"").lower())
                spans, met, longest = sa.match(words)
                out.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "spans": [{"start": a, "end": b} for a, b in spans], "texts": sorted(met), "longest": longest})
            yield out

    return text_udf(run, FOUND)("text")


def joined_spans(spans: Column) -> Column:
    """Spans from several blocks, merged where they meet."""
    kind = "struct<done: array<struct<start: int, end: int>>, start: int, end: int>"

    def step(acc: Column, s: Column) -> Column:
        done = F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
        grown = F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"))
        return F.when((acc["end"] >= 0) & (s["start"] <= acc["end"]), grown).otherwise(F.struct(done.alias("done"), s["start"].alias("start"), s["end"].alias("end")))

    none = F.struct(F.array().cast("array<struct<start: int, end: int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")).cast(kind)
    return F.aggregate(F.array_sort(spans), none, step, lambda acc: F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))))


def found(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, spans (word offsets), texts (keys of item texts), longest."""
    spark = docs.sparkSession
    cut = stored(pieces(benchmark, window, max(window, min(piece_words, max(block_words, 4 * window)))), "pieces")
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))

    def block(k: int) -> list[tuple[int, bytes]]:
        rows = cut.where(F.pmod("h", F.lit(blocks)) == k).select("key", F.array_join("words", " ").cast("binary"))
        return [(r[0], bytes(r[1])) for r in rows.collect()]  # about block_words words

    if blocks == 1:
        return docs.withColumn(name, search(spark, block(0), window))
    keyed, keys = row_keyed(docs, "documents")
    hits = []
    for k in range(blocks):
        one = keyed.select(*keys, search(spark, block(k), window).alias("f")).where(F.col("f.longest") > 0)
        hits.append(stored(one, "hits"))
    every = reduce(DataFrame.union, hits).groupBy(*keys)
    merged = every.agg(joined_spans(F.flatten(F.collect_list("f.spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.texts")))).alias("texts"), F.max("f.longest").alias("longest"))
    both, long = fresh(docs, "_hits"), fresh(docs, "_long")
    slim = merged.select(*keys, F.struct("spans", "texts", "longest").alias(both))
    n = F.coalesce(F.regexp_count(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD_SQL)), F.lit(0)).cast("bigint")
    hit = F.coalesce(F.aggregate(F.col(both)["spans"], F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"]), F.lit(0).cast("bigint"))
    none = F.array()
    whole = F.struct(F.col(long).alias("n_words"), hit.alias("n_hit"), F.coalesce(F.col(both)["spans"], none).alias("spans"), F.coalesce(F.col(both)["texts"], none).alias("texts"), F.coalesce(F.col(both)["longest"], F.lit(0)).alias("longest"))
    # words are counted before the join, so a text that is not asked for does not travel
    return joined_back(keyed.withColumn(long, n), slim, keys, "left").withColumn(name, whole.cast(FOUND)).select(*named(docs.columns), name)


ADDED = ("n_words", "n_hit", "spans", "items", "longest")


def matches(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``columns`` of ``docs`` with n_words, n_hit, spans (word offsets), items (ids as strings, sorted) and longest.

    The rows are stored. Items are named for each distinct set of texts, not for each document.
    """
    with temporary(docs.sparkSession) as keep:
        own = fresh(docs, "_found")
        columns = [c for c in without(docs, ADDED) if c in columns]
        rows = keep(stored(found(docs, benchmark, own, window, block_words, piece_words).select(*named(columns), own), "matches"))
        texts = F.col(f"{own}.texts")
        sets = rows.where(F.size(texts) > 0).select(texts.alias("texts")).distinct()
        of = item_texts(benchmark).select("item", "key")
        ids = sets.select("texts", F.explode("texts").alias("key")).join(of, "key").groupBy("texts").agg(F.array_sort(F.collect_set("item")).alias("items"))
        met = fresh(rows, "_texts")
        ids = keep(stored(ids.withColumnRenamed("texts", met), "item-sets"))
    hit = rows.where(F.size(texts) > 0).join(ids, texts == F.col(met))
    every = hit.select(*named(rows.columns), "items").union(rows.where(F.size(texts) == 0).withColumn("items", F.array().cast("array<string>")))
    return every.select(*named(columns), *[f"{own}.{c}" if c != "items" else c for c in ADDED])


def contaminated(coverage_parts: int = 20, of: str | None = None) -> Column:
    """Marked words are at least one in ``coverage_parts`` of all words; ``of``: the struct column that has the counts."""
    hit, n = (F.col(c if of is None else f"{of}.{c}") for c in ("n_hit", "n_words"))
    return (hit > 0) & (hit * coverage_parts >= n)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without its spans of words; what stood between two spans stays."""
    if text is None or not spans:
        return text
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, data[done:]]).decode("utf-8", "replace")


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage_parts: int = 20, cut_length: int | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents; with ``cut_length``, spans of so many words leave the texts that stay."""
    own = fresh(docs, "_found")
    kept = found(docs, benchmark, own, window)
    kept = kept.where(~contaminated(coverage_parts, own))
    if cut_length is not None:

        @F.pandas_udf("string")
        def cut(text, spans):
            import pandas as pd

            return pd.Series([cut_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)

        long = F.filter(F.col(own)["spans"], lambda s: s["end"] - s["start"] >= cut_length)
        kept = kept.withColumn("text", F.when(F.size(long) > 0, cut("text", long)).otherwise(F.col("text")))
    return kept.select(*named(docs.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    m = matches(docs, benchmark, ["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
