"""Katz back-off language model: trained, stored and scored by distributed tables.

The probability of a token w after v is the Good-Turing discounted share of (v, w) among the
training pairs that begin with v, if that pair occurred; else it backs off to ``alpha(v)``
times the unigram probability of w, which backs off to one slot for unknown tokens. The
weights alpha are exact: for each v they make all probabilities sum to one.

How it runs. Texts are cut into *chunks* of about ``CHUNK`` tokens, each holding its
documents as indexes into its own distinct words. A chunk asks for each distinct word once,
and later for each distinct pair once; the askings of all chunks meet in *buckets* by a hash
(words) or by the context (pairs), so that a word or pair costs one entry for each chunk that
has it, however often it occurs. A bucket adds up the counts, keeps its part of the table and
answers in the order it was asked. A chunk asks for every known context it has, also where no
known word follows, as only the answer says what a context leaves to unseen words. A context
that makes up more than an eighth of a bucket is *hot*: its pairs are dealt over all buckets,
and its sums are added by word and joined to the chunks that have it. Only totals of the whole
corpus reach the driver.

Words are told apart by 64-bit hashes; a word's id is its bucket and its place there, 32 bits
each. Tables under ``table_path`` (a folder of the run's own, removed at its end, where none is
given): words (bucket, hash, count) and pairs (bucket, v, w, count) as arrays in Parquet, a row
for each bucket.

Discounts: for counts r to K = 5, (r*/r - A) / (1 - A) with r* = (r+1) n(r+1)/n(r) and
A = (K+1) n(K+1)/n(1). Where the corpus is too small for all of them to lie in (0, 1], K is
lowered; if none is left, (r - 0.5)/r is used. A context that its discounts leave nothing to
give away gives away 1 in (its total + 1).

Defined results: null text is empty and has its end token only; a null doc_id counts as the
empty text for the fold; repeated rows are rows of their own; an empty training set scores
every token as the one unknown slot, log10(1); an empty table gives an empty result; other
columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cleaned_shuffles, hash_words, held_out, joined_texts, mix, mix_int, remove_path, scratch_path, stored, temporary, words_of

U64, U32 = np.uint64, np.uint32
CHUNK = 1_500_000
BUCKET = 1_500_000
K = 5
END = mix_int(0xE0D)

# ---------------------------------------------------------------- arrays in cells


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of an array (of differences, where it rises), plane by plane, compressed."""
    a = np.ascontiguousarray(a)
    if rising and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, kind=U64, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    a = np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)
    return np.cumsum(a, dtype=kind) if rising and len(a) else a


# ---------------------------------------------------------------- chunks

CHUNKS = "chunk long, ids binary, nulls binary, held binary, lens binary, tokens binary, words binary, train binary"


def _chunk_row(part: int, ids: list, held: list, hashes: list[np.ndarray]) -> tuple:
    lens = np.array([len(h) + 1 for h in hashes], np.int64)
    stop = np.cumsum(lens) - 1
    h = np.empty(int(lens.sum()), U64)
    inner = np.ones(len(h), bool)
    inner[stop] = False
    h[inner] = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    h[stop] = END
    words, tokens = np.unique(h, return_inverse=True)
    train = np.bincount(tokens[~np.repeat(np.array(held, bool), lens)], minlength=len(words))
    return (
        part, pack(np.array([0 if i is None else i for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8)), pack(np.array(held, np.uint8)),
        pack(lens), pack(tokens.astype(U32)), pack(words, True), pack(train.astype(U64)),
    )


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at, made = TaskContext.get().partitionId() << 24, 0
    ids: list = []
    held: list = []
    hashes: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        cells = _chunk_row(at + made, ids, held, hashes)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(cells)], names=[c.split()[0] for c in CHUNKS.split(", ")])

    for batch in batches:
        texts = [(x or b"").lower() for x in batch.column("_text").cast(pa.binary()).to_pylist()]
        numbers, folds = batch.column("_id").to_pylist(), batch.column("_held").to_pylist()
        for i, j, data, offsets in joined_texts(texts):
            buf = np.frombuffer(data, np.uint8)
            starts, ends = words_of(buf)
            h = hash_words(buf, starts, ends)
            first = np.searchsorted(starts, offsets)
            for d in range(i, j):
                ids.append(numbers[d])
                held.append(folds[d])
                hashes.append(h[first[d - i] : first[d - i + 1]])
                size += len(hashes[-1]) + 1
            if size >= limit:
                yield row()
                made += 1
                ids, held, hashes, size = [], [], [], 0
    if ids:
        yield row()


def chunks(docs: DataFrame, fold: int, folds: int, limit: int = CHUNK) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), held_out(F.col("doc_id"), folds, fold).alias("_held"), F.col("text").alias("_text"))
    return rows.mapInArrow(lambda batches: _chunks(batches, limit), CHUNKS)


# ---------------------------------------------------------------- words

ASKED = "bucket int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
SAID = "kind string, bucket int, chunk long, a binary, b binary, c binary, d binary, word long, sums array<double>"


def _rows(rows: list[tuple], spec: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in spec.split(", ")])


def ask_words(table: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's words and training counts, cut by ranges of the hash."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], U64)

    def run(batches):
        for batch in batches:
            for chunk, w, t in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "train")), strict=True):
                words, train = unpack(w, U64, True), unpack(t)
                cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                rows = [(k, chunk, pack(words[a:b], True), pack(train[a:b]), None, None, None, None) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_pandas(_rows(rows, ASKED), schema=_ASKED, preserve_index=False)

    return table.select("chunk", "words", "train").mapInArrow(run, ASKED)


_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in "abcdef"]])


def spectrum(counts: np.ndarray) -> list[float]:
    """How many counts are 1, 2, ... K + 1."""
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].astype(float).tolist()


def _answer_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of a bucket's words over all chunks; every chunk gets counts and places in its own order."""
    asked = [(unpack(a, U64, True), unpack(b)) for a, b in zip(rows.a, rows.b, strict=True)]
    words, where = np.unique(np.concatenate([w for w, _ in asked]), return_inverse=True)
    total = np.zeros(len(words), U64)
    np.add.at(total, where, np.concatenate([t for _, t in asked]))
    seen = total > 0
    place = np.cumsum(seen).astype(U64)  # from 1; 0: not in training
    place[~seen] = 0
    out, at = [], 0
    for chunk, (w, _) in zip(rows.chunk, asked, strict=True):
        here = where[at : at + len(w)]
        at += len(w)
        out.append(("reply", rows.bucket.iloc[0], chunk, pack(total[here]), pack(place[here].astype(U32)), None, None, None, None))
    kept = total[seen]
    sums = [float(seen.sum()), float(kept.sum()), *spectrum(kept)]
    return _rows([*out, ("table", rows.bucket.iloc[0], None, pack(words[seen], True), pack(kept), None, None, None, sums)], SAID)


def ids_of(buckets, places: list[np.ndarray]) -> np.ndarray:
    """Ids of words from their buckets and places there (from 1; 0: not in training, and so is the id)."""
    return np.concatenate([np.where(p > 0, (U64(b) << U64(32)) | p.astype(U64), U64(0)) for b, p in zip(buckets, places, strict=True)])


# ---------------------------------------------------------------- discounts


def discounts(n: list[float]) -> list[float]:
    """d(1) ... d(K); n: how many grams occur 1, 2, ... K + 1 times."""
    for k in range(K, 0, -1):
        if all(x > 0 for x in n[: k + 1]):
            a = (k + 1) * n[k] / n[0]
            if a < 1:
                d = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) for r in range(1, k + 1)]
                if all(0 < x <= 1 for x in d):
                    return d + [1.0] * (K - k)
    return [(r - 0.5) / r for r in range(1, K + 1)]


class Unigram:
    """Discounted unigram probabilities; what the discounts free is the one unknown slot's."""

    def __init__(self, total: float, types: float, n: list[float]):
        self.total, self.types, self.d = total, types, discounts(n)
        freed = sum((1 - d) * r * m for r, (d, m) in enumerate(zip(self.d, n, strict=False), 1)) / total if total else 1.0
        self.unknown = max(freed, 1 / (total + 1))
        self.scale = (1 - self.unknown) / (1 - freed) if freed < 1 else 0.0
        self._d = np.array([0.0, *self.d])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(float)
        d = np.where(counts <= K, self._d[np.minimum(counts, K).astype(np.int64)], 1.0)
        return np.where(counts > 0, self.scale * d * c / max(self.total, 1), self.unknown)


# ---------------------------------------------------------------- pairs


def _decode(chunk: pd.DataFrame, replies: pd.DataFrame, least: float) -> dict:
    """A chunk with its words' counts and ids, and its distinct pairs; ``hot``: pairs whose context is.

    A pair is (v, w) as indexes of the chunk's words, v = -1 before the first token.
    """
    c = chunk.iloc[0]
    lens, tokens = unpack(c.lens, np.int64), unpack(c.tokens, U32).astype(np.int64)
    replies = replies[replies.kind == "reply"].sort_values("bucket")
    count = np.concatenate([unpack(a) for a in replies.a])
    ids = ids_of(replies.bucket, [unpack(b, U32) for b in replies.b])
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[np.cumsum(lens) - lens] = -1
    train = np.repeat(unpack(c.held, np.uint8) == 0, lens)
    pairs, where = np.unique((v + 1) * (len(ids) + 1) + tokens, return_inverse=True)
    pv, pw = pairs // (len(ids) + 1) - 1, pairs % (len(ids) + 1)
    return {
        "c": c, "lens": lens, "where": where, "count": count, "ids": ids, "pv": pv, "pw": pw, "n": np.bincount(where[train], minlength=len(pairs)),
        "vid": np.where(pv < 0, U64(0), ids[pv]), "hot": (pv < 0) | (count[pv] >= least),
    }


def _asked_pairs(x: dict, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indexes of pairs in order of context id, then word id): pairs that can have a count, and every known context that isn't hot."""
    known = (x["pv"] < 0) | (x["vid"] > 0)
    can = np.flatnonzero(known & ((x["ids"][x["pw"]] > 0) | ~x["hot"]))
    v, w = x["vid"][can], x["ids"][x["pw"]][can]
    at = mix(np.where(x["hot"][can], v * U64(0x9E3779B97F4A7C15) + w, v)) % U64(buckets)
    order = np.lexsort((w, v, at))
    can, at = can[order], at[order]
    cut = np.searchsorted(at, np.arange(buckets + 1).astype(U64))
    return [(b, can[cut[b] : cut[b + 1]]) for b in range(buckets)]


def _answer_pairs(rows: pd.DataFrame, unigram: Unigram) -> pd.DataFrame:
    """Counts of a bucket's pairs; sums of each context: total, how many counts are 1..K, and the followers' unigram mass."""
    asked = []
    for r in rows.itertuples():
        followers = unpack(r.b, U32).astype(np.int64)
        v = np.repeat(unpack(r.a, U64, True), followers)
        asked.append((v, unpack(r.c), unpack(r.d), unpack(r.e), np.repeat(unpack(r.f, np.uint8), followers)))
    av, aw, n, c, hot = (np.concatenate([x[k] for x in asked]) for k in range(5))
    order = np.lexsort((aw, av))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (av[order][1:] != av[order][:-1]) | (aw[order][1:] != aw[order][:-1])
    first = order[fresh]
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(fresh) - 1
    total = np.zeros(len(first), U64)
    np.add.at(total, where, n)
    seen = total > 0
    v, begin = np.unique(av[first][seen], return_index=True)
    t, p = total[seen], unigram(c[first][seen])
    sums = [np.add.reduceat(y, begin) if len(v) else np.zeros(0) for y in (t.astype(float), *[(t == r).astype(float) for r in range(1, K + 1)], p)]
    warm = hot[first][seen][begin] == 1
    cold = v[~warm]
    out, at, bucket = [], 0, rows.bucket.iloc[0]
    for chunk, (own, *_) in zip(rows.chunk, asked, strict=True):
        here = where[at : at + len(own)]
        at += len(own)
        own = np.intersect1d(own, cold)
        i = np.searchsorted(v, own)
        cells = [pack(own, True), pack(total[here]), pack(np.stack([s[i] for s in sums[:-1]]).astype(U32).reshape(-1)), pack(sums[-1][i])]
        out.append(("reply", bucket, chunk, *cells, None, None))
    out += [("hot", bucket, None, None, None, None, None, int(v[i]), [float(s[i]) for s in sums]) for i in np.flatnonzero(warm)]
    table = [pack(av[first][seen], True), pack(aw[first][seen]), pack(t), None]
    return _rows([*out, ("table", bucket, None, *table, None, spectrum(t))], SAID)


def hot_contexts(replies: DataFrame, least: float) -> DataFrame:
    """(word, chunk): the hot contexts that each chunk has, its start (word 0) included."""

    def run(batches):
        for batch in batches:
            for bucket, chunk, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "a", "b")), strict=True):
                place = unpack(b, U32)
                at = np.flatnonzero((unpack(a) >= least) & (place > 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids_of([bucket], [place[at]]).view(np.int64)), pa.array([chunk] * len(at), pa.int64())], names=["word", "chunk"])

    starts = replies.select(F.lit(0).cast("long").alias("word"), "chunk").distinct()
    return replies.select("bucket", "chunk", "a", "b").mapInArrow(run, "word long, chunk long").union(starts)


def _score(x: dict, replies: pd.DataFrame, hot: pd.DataFrame, asked: list, unigram: Unigram, d2: np.ndarray) -> pd.DataFrame:
    pv, pw, vid = x["pv"], x["pw"], x["vid"]
    seen = np.zeros(len(pv))
    by = {r.bucket: r for r in replies.itertuples()}
    stats = [(hot.word.to_numpy().astype(U64), np.stack(hot.sums.to_list(), axis=1))] if len(hot) else []
    for b, at in asked:
        if b in by and len(at):
            r = by[b]
            seen[at] = unpack(r.b).astype(float)
            v = unpack(r.a, U64, True)
            stats.append((v, np.concatenate([unpack(r.c, U32).reshape(K + 1, len(v)).astype(float), unpack(r.d, np.float64)[None]])))
    known = np.concatenate([v for v, _ in stats]) if stats else np.zeros(0, U64)
    table = np.concatenate([s for _, s in stats], axis=1) if stats else np.zeros((K + 2, 0))
    order = np.argsort(known)
    known, table = known[order], table[:, order]
    place = np.searchsorted(known, vid)
    has = (place < len(known)) & ((pv < 0) | (vid > 0))
    has[has] = known[place[has]] == vid[has]
    low = unigram(x["count"][pw])
    p = low.copy()
    s = table[:, place[has]]
    total, mass = s[0], s[-1]
    freed = ((1 - d2)[:, None] * np.arange(1, K + 1)[:, None] * s[1:-1]).sum(axis=0) / total
    left = np.maximum(freed, 1 / (total + 1))
    n = seen[has]
    d = np.where(n <= K, np.concatenate([[0.0], d2])[np.minimum(n, K).astype(np.int64)], 1.0)
    p[has] = np.where(n > 0, (1 - left) / (1 - freed) * d * n / total, left / (1 - mass) * low[has])
    c = x["c"]
    types = unigram.types
    base = np.log10((x["count"].astype(float) + 1) / (unigram.total + types + 1))
    start = np.cumsum(x["lens"]) - x["lens"]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[x["where"]], start)

    nulls = unpack(c.nulls, np.uint8) == 1
    out = pd.DataFrame({
        "doc_id": pd.array(unpack(c.ids, np.int64), "Int64"),
        "held_out": unpack(c.held, np.uint8) == 1, "n_tokens": x["lens"], "n_known": summed((x["count"][pw] > 0).astype(np.int64)),
        "train_tokens": np.full(len(x["lens"]), int(unigram.total)), "base_score": summed(base[pw]), "score": summed(np.log10(p)),
    })
    out.loc[nulls, "doc_id"] = pd.NA
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def train_and_score(docs: DataFrame, folds: int = 7, fold: int = 2, table_path: str | None = None, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """Learns from the rows outside the fold and scores every row."""
    spark = docs.sparkSession
    at = table_path or scratch_path(spark, "katz")
    with temporary(spark) as keep:
        scores = keep(stored(_scores(docs, folds, fold, at, chunk, bucket), "scores"))
    if table_path is None:
        remove_path(spark, at)
    return scores


def _scores(docs: DataFrame, folds: int, fold: int, table_path: str, chunk: int, bucket: int) -> DataFrame:
    spark = docs.sparkSession
    table = stored(chunks(docs, fold, folds, chunk), "chunks")
    n_chunks = table.count()
    if not n_chunks:
        return spark.createDataFrame([], SCORES)
    buckets = max(8, -(-n_chunks * chunk // bucket))

    words = ask_words(table, buckets).groupBy("bucket").applyInPandas(_answer_words, SAID)
    with cleaned_shuffles(spark):
        words.write.partitionBy("kind").parquet(f"{table_path}/words")
    words = spark.read.schema(SAID).parquet(f"{table_path}/words")
    types, total, *n = words.where("kind = 'table'").select(*[F.sum(F.col("sums")[k]) for k in range(K + 3)]).first()
    unigram = Unigram(total, types, n)
    least = max(1.0, total / (8 * buckets))  # training count from which a context is hot

    def asking(chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        x = _decode(chunk, replies, least)
        rows = []
        for b, at in _asked_pairs(x, buckets):
            if len(at):
                v, first, followers = np.unique(x["vid"][at], return_index=True, return_counts=True)
                w = x["pw"][at]
                cells = [pack(v, True), pack(followers.astype(U32)), pack(x["ids"][w]), pack(x["n"][at].astype(U64)), pack(x["count"][w]), pack(x["hot"][at][first].astype(np.uint8))]
                rows.append((b, x["c"].chunk, *cells))
        return _rows(rows, ASKED)

    replies = words.where("kind = 'reply'")
    table = table.drop("words", "train")  # asked and answered
    asked = table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(asking, ASKED)
    pairs = asked.groupBy("bucket").applyInPandas(lambda rows: _answer_pairs(rows, unigram), SAID)
    with cleaned_shuffles(spark):
        pairs.write.partitionBy("kind").parquet(f"{table_path}/pairs")
    pairs = spark.read.schema(SAID).parquet(f"{table_path}/pairs")
    n = pairs.where("kind = 'table'").select(*[F.sum(F.col("sums")[k]) for k in range(K + 1)]).first()
    d2 = np.array(discounts([x or 0.0 for x in n]))
    warm = pairs.where("kind = 'hot'").groupBy("word").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(K + 2)]).alias("sums"))
    warm = hot_contexts(replies, least).join(warm, "word")

    def scoring(chunk: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        x = _decode(chunk, said[said.step == "words"], least)
        return _score(x, said[said.step == "pairs"], said[said.step == "hot"], _asked_pairs(x, buckets), unigram, d2)

    cols = ["kind", "bucket", "chunk", "a", "b", "c", "d", "word", "sums"]
    own = {c: F.col(c) for c in ("chunk", "word", "sums")}
    hot = warm.select(*[own.get(c, F.lit(None).cast(t)).alias(c) for c, t in replies.select(*cols).dtypes])
    said = replies.select(*cols, F.lit("words").alias("step")).union(pairs.where("kind = 'reply'").select(*cols, F.lit("pairs").alias("step"))).union(hot.withColumn("step", F.lit("hot")))
    return table.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(scoring, SCORES)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_katz": op2_katz}
ORACLES: dict[str, str] = {}
