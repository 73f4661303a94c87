"""Near-duplicates by a chosen-path set similarity join, and their connected components.

A text's set is its distinct 5-word shingles; texts of equal sets are one *class* from the
start. Every class has ``COORDS`` minwise tokens. In each of ``trees`` independent trees a
node chooses one or two of the coordinates (1/threshold of them on average, from a hash of
the node's path) and sends each of its classes on to the children named by the tokens there,
so similar sets keep meeting and others part. The tree is grown level by level over all nodes
at once; a node that holds one class, or only classes already in one component, is done.

The classes of a small node (``leaf`` of them) are compared exhaustively: first by sketches
(the low bytes of 128 minwise hashes), then by a sample of the sets themselves, which up to 512
shingles is the whole set in 16 bits each. Of the pairs that pass, a node passes on a spanning
forest of those well above the threshold and all others that its trees don't join already, so
their number is linear in the classes; every one is confirmed on full sets, and components
grow from confirmed pairs only. A larger node branches; after ``depth`` levels it is compared
in blocks, all against all, so nothing is capped. The first ``FIRST`` trees run alone; the
others then look only at nodes that still hold several components.

A pair at the threshold fails the sketches with a chance below CHANCE. It meets in one tree
with chance ``threshold`` for each level, so 16 trees miss one in 10^13 of those that part
from the rest at the first level and one in 10^4 after four.

A node's forest takes pairs well above the threshold for links. Where confirmation finds that
one is none, its two classes are in doubt, and the nodes that hold such a class are compared once more:
a pair with it joins nothing by itself, so every pair of it is confirmed; until no such pair fails.

Texts are read three to four times and shuffled once, by :func:`deduplicated`, for the result;
what the join works with are rows of about a kilobyte without texts, and rows are named by their
keys (file and place).

Defined results: null, blank and wordless texts have the empty set and stand alone; rows of
equal texts, ids included, are one class; a null doc_id never names a component that has
another id; an empty table gives an empty result; :func:`deduplicated` returns rows with all
their columns as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hash_words, is_empty, joined_back, joined_texts, mix, mix_int, row_keyed, small_batches, stored, temporary, words_of

U64 = np.uint64
WIDTH = 5
COORDS = 64  # minwise tokens that trees branch on
SKETCH = 128  # coordinates, those included, of which a sketch has the low byte
CHANCE = 1e-4
THRESHOLD = 0.85
TREES = 16
FIRST = 4
LEAF = 2048
DEPTH = 6
SAMPLE = 512
BLOOM_BITS = 1 << 28  # of the filter, at most
_MULT = mix(np.arange(1, SKETCH + 1, dtype=U64)) | U64(1)
_PLACE = mix(np.arange(101, 101 + WIDTH, dtype=U64)) | U64(1)

# ---------------------------------------------------------------- sets and tokens


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (UTF-8 bytes)."""
    for i, j, data, offsets in joined_texts([t.lower() for t in texts]):
        buf = np.frombuffer(data, np.uint8)
        starts, ends = words_of(buf)
        h = hash_words(buf, starts, ends)
        first = np.searchsorted(starts, offsets)
        rolled = np.zeros(max(0, len(h) - WIDTH + 1), U64)
        for k in range(WIDTH):
            rolled += h[k : len(h) - WIDTH + 1 + k] * _PLACE[k] if len(rolled) else U64(0)
        rolled = mix(rolled)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= WIDTH:
                yield np.unique(rolled[a : b - WIDTH + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _PLACE[: b - a]).sum() + U64(b - a)], U64))
            else:
                yield np.zeros(0, U64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minwise(s: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each coordinate's smallest product."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(s), 512):
        np.minimum(best, (s[at : at + 512, None] * _MULT).min(axis=0), out=best)
    return (best >> U64(32)).astype(np.uint32)


def sample(s: np.ndarray) -> bytes:
    """Hashes below 2^(64 - r), in order, for the least r that leaves SAMPLE at most: r, how many stay for r + 1, their low 16 bits."""
    r = 0
    while len(s) > SAMPLE:
        r += 1
        s = s[: np.searchsorted(s, U64(1) << U64(64 - r))]
    half = int(np.searchsorted(s, U64(1) << U64(63 - r)))
    return np.concatenate([np.array([r, half], np.uint16), s.astype(np.uint16)]).tobytes()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


ROW = "file long, place long, doc_id long, mark long, n long, key binary, tokens binary, sketch binary, fine binary"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, tokens, sketches, fine = [], [], [], [], []
        for s in shingle_sets(_texts(batch, "text")):
            t = minwise(s) if len(s) else None
            n.append(len(s))
            keys.append(None if t is None else set_key(s))
            tokens.append(None if t is None else t[:COORDS].tobytes())
            sketches.append(None if t is None else t.astype(np.uint8).tobytes())
            fine.append(None if t is None else sample(s))
        blobs = [pa.array(x, pa.binary()) for x in (keys, tokens, sketches, fine)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "place", "doc_id", "mark")), pa.array(n, pa.int64()), *blobs], names=[c.split()[0] for c in ROW.split(", ")])


def keyed(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(file, place, doc_id, mark, n, key, tokens, sketch, fine) of each row: its keys, the text's hash, its set's
    size and digest, the minwise tokens, their low bytes and the sample; the last four null for the empty set."""
    file, place = keys
    rows = docs.select(F.col(file).alias("file"), F.col(place).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").alias("text"))
    return rows.mapInArrow(_keyed, ROW)


# ---------------------------------------------------------------- trees


def children(nodes: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes and the row each comes from: one coordinate for each row's node, or two."""
    draw = mix(nodes ^ U64(0x5851F42D4C957F2D))
    two = (mix(draw + U64(1)) >> U64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1
    first = (draw % U64(COORDS)).astype(np.int64)
    second = (first + 1 + (mix(draw + U64(2)) % U64(COORDS - 1)).astype(np.int64)) % COORDS
    rows = np.arange(len(nodes))

    def named(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix(mix(nodes[r] * U64(3) + c.astype(U64)) ^ tokens[r, c].astype(U64) * U64(0x9E3779B97F4A7C15))

    also = rows[two]
    return np.concatenate([named(rows, first), named(also, second[also])]), np.concatenate([rows, also])


def _grow(batches: Iterator[pa.RecordBatch], roots: np.ndarray | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, COORDS)
        for root in [None] if roots is None else roots:
            nodes = batch.column("node").to_numpy().view(U64) if roots is None else np.full(batch.num_rows, root, U64)
            child, rows = children(nodes, tokens, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("key").take(pa.array(rows))], names=["node", "key"])


def grown(rows: DataFrame, threshold: float, trees: range | None = None) -> DataFrame:
    """(node, key) one level down; with ``trees``, from their roots."""
    roots = None if trees is None else np.array([mix_int(0xC0FFEE + t) for t in trees], U64)

    def run(batches):
        return _grow(batches, roots, threshold)

    return rows.mapInArrow(run, "node long, key binary")


# ---------------------------------------------------------------- pairs


def least_agreement(threshold: float) -> int:
    """Bytes of a sketch that agree for a pair at ``threshold`` but with a chance below CHANCE."""
    from math import comb

    total, k = 0.0, 0
    while (total := total + comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)) < CHANCE:
        k += 1
    return k


class Node:
    """The classes of one node, and which pairs of them to confirm."""

    def __init__(self, part: list[bytes], n: np.ndarray, sketch: np.ndarray, fine: list[bytes], doubt: np.ndarray, per_cent: int, margin: float):
        self.n, self.sketch, self.doubt, self.limit, self.margin = n, sketch, doubt, per_cent / 100, margin
        self.fine = [np.frombuffer(f, np.uint16) for f in fine]
        ids: dict[bytes, int] = {}
        self.part = np.array([ids.setdefault(p, len(ids)) for p in part])
        self.up = list(range(len(ids)))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def similar(self, i: int, js: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of Jaccard with each of ``js``, and how far each may be off."""
        f = self.fine[i]
        est, off = np.zeros(len(js)), np.zeros(len(js))
        for r in {int(self.fine[j][0]) for j in js}:
            at = np.flatnonzero([self.fine[j][0] == r for j in js])
            mine = f[2:] if r <= f[0] else f[2 : 2 + f[1]] if r == f[0] + 1 else f[:0]
            theirs = [self.fine[j][2:] if r >= f[0] else self.fine[j][2 : 2 + self.fine[j][1]] for j in js[at]]
            mark[mine] = True
            size = np.array([len(t) for t in theirs])
            hits = np.concatenate([[0], np.cumsum(mark[np.concatenate(theirs)])])
            both = hits[np.cumsum(size)] - hits[np.cumsum(size) - size]
            mark[mine] = False
            both = np.minimum(both, len(mine))
            est[at] = both / np.maximum(len(mine) + size - both, 1)
            off[at] = 0.015 if max(r, f[0]) == 0 else 0.09
        return est, off

    def pairs(self, least: int, mark: np.ndarray) -> list[tuple[int, int, bool]]:
        """Pairs to confirm, and whether the node takes them for links."""
        found: list[tuple[float, int, int]] = []
        unsure: list[tuple[int, int]] = []
        for i in range(len(self.n) - 1):
            j = np.arange(i + 1, len(self.n))
            j = j[(self.part[j] != self.part[i]) & (self.n[j] >= self.n[i] * self.limit) & (self.n[i] >= self.n[j] * self.limit)]
            j = j[(self.sketch[j] == self.sketch[i]).sum(axis=1) >= least] if len(j) else j
            if len(j):
                est, off = self.similar(i, j, mark)
                firm = (est >= self.limit + self.margin * off) & ~(self.doubt[i] | self.doubt[j])
                found += [(-e, i, int(k)) for e, k in zip(est[firm].tolist(), j[firm], strict=True)]
                unsure += [(i, int(k)) for k in j[~firm & (est > self.limit - off)]]
        out = []
        for _, i, j in sorted(found):
            a, b = self.root(self.part[i]), self.root(self.part[j])
            if a != b:
                self.up[a] = b
                out.append((i, j, True))
        return out + [(i, j, False) for i, j in unsure if self.root(self.part[i]) != self.root(self.part[j])]


PAIR = "a binary, b binary, firm boolean"


def _in_nodes(batches: Iterator[pa.RecordBatch], per_cent: int, margin: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, key, part, n, sketch, fine, doubt) in order of node: pairs across parts to confirm."""
    least, kept, mark = least_agreement(per_cent / 100), None, np.zeros(1 << 16, bool)
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = [x for x in (kept, batch and pa.Table.from_batches([batch])) if x is not None]
        if not rows:
            continue
        table = pa.concat_tables(rows).combine_chunks()
        node = table.column("node").to_numpy()
        end = len(node) if batch is None else int(np.searchsorted(node, node[-1]))  # the last node may go on
        kept = table.slice(end)
        if not end:
            continue
        edge = np.flatnonzero(np.r_[True, node[1:end] != node[: end - 1]])
        size = np.diff(np.r_[edge, end])
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        key, part, fine = (table.column(c).to_pylist() for c in ("key", "part", "fine"))
        n, doubt = table.column("n").to_numpy().astype(float), table.column("doubt").to_numpy()
        apart = np.zeros(len(edge), bool)
        apart[size == 2] = (sketch[edge[size == 2]] == sketch[edge[size == 2] + 1]).sum(axis=1) < least
        out: list[tuple[bytes, bytes, bool]] = []
        for at, m in zip(edge[~apart].tolist(), size[~apart].tolist(), strict=True):
            own = slice(at, at + m)
            for i, j, firm in Node(part[own], n[own], sketch[own], fine[own], doubt[own], per_cent, margin).pairs(least, mark):
                x, y = key[at + i], key[at + j]
                out.append((x, y, firm) if x < y else (y, x, firm))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["a", "b", "firm"])


def in_nodes(rows: DataFrame, per_cent: int, margin: float) -> DataFrame:
    def run(batches):
        return _in_nodes(batches, per_cent, margin)

    return rows.select("node", "key", "part", "n", "sketch", "fine", "doubt").repartition("node").sortWithinPartitions("node").mapInArrow(run, PAIR)


def blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """Nodes of any size (node, key, part, size) as nodes of about ``leaf`` rows in which every two rows meet."""
    n = F.ceil(F.col("size") * 2 / leaf).cast("int")
    own = F.pmod(F.xxhash64("key"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    cut = rows.withColumn("_own", own).select("*", other.alias("_other"))
    return cut.withColumn("node", F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other"))).select("node", "key", "part")


def filter_bits(n: int) -> int:
    """Bits of a Bloom filter over ``n`` keys with two hashes: 16 to 32 for each, a power of two, BLOOM_BITS at most."""
    return min(BLOOM_BITS, max(1 << 16, 1 << (16 * n - 1).bit_length()))


def bloom_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over keys; its words are or-ed in the tasks."""

    def run(batches):
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column("key").to_pylist()), U64) % U64(bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], names=["w", "v"])

    out = np.zeros(bits // 64, np.int64)
    words = keys.select("key").mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # bits / 64 rows at most
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out


def full_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, members): the shingle hashes of the classes in ``keys``, from the texts again.

    A Bloom filter of bounded size keeps most other texts' sets in their tasks; what a false
    positive lets through meets no pair. One copy of each set leaves a task.
    """
    bits = filter_bits(keys.count())
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(keys, bits))

    def run(batches):
        words = shared.value.view(U64)
        sent: set[bytes] = set()
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for s in shingle_sets(_texts(batch, "text")):
                if len(s) and (key := set_key(s)) not in sent:
                    at = np.frombuffer(key, U64) % U64(bits)
                    if ((words[at >> U64(6)] >> (at & U64(63))) & U64(1)).all():
                        sent.add(key)
                        found.append((key, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["key", "members"])

    return docs.select("text").mapInArrow(run, "key binary, members binary").groupBy("key").agg(F.first("members").alias("members"))


def confirmed(pairs: DataFrame, docs: DataFrame, per_cent: int) -> DataFrame:
    """The pairs with 100 * |a & b| >= per_cent * |a | b|, on full sets."""
    keys = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "asked")
    sets = stored(full_sets(docs, keys), "sets")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(u) + len(v) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every key in ``links`` (a, b): root is the smallest key reachable.

    Each round hooks every key to its smallest neighbour, shortens the paths to their roots,
    and keeps only links between roots; at least half of the roots that still have links go.
    """
    with temporary(links.sparkSession) as keep:
        return keep(stored(_components(links), "components"))


def _components(links: DataFrame) -> DataFrame:
    labels = links.sparkSession.createDataFrame([], "key binary, root binary")
    edges, first = links, True
    while not is_empty(edges):
        both = edges.select(F.col("a").alias("key"), F.col("b").alias("to")).union(edges.select("b", "a"))
        up = stored(both.groupBy("key").agg(F.min("to").alias("to")).select("key", F.least("key", "to").alias("root")), "hooks")
        while True:
            onward = up.select(F.col("key").alias("root"), F.col("root").alias("next"))
            step = stored(up.join(onward, "root").select("key", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            up = step.select("key", "root")
            if is_empty(step.where("moved")):
                break
        if first:
            labels, first = up, False
        else:
            onward = up.select(F.col("key").alias("root"), F.col("root").alias("next"))
            labels = stored(labels.join(onward, "root", "left").select("key", F.coalesce("next", "root").alias("root")), "labels")
        a, b = (up.select(F.col("key").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = stored(edges.join(a, "a").join(b, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels


# ---------------------------------------------------------------- the join


@dataclass(frozen=True)
class How:
    """``margin``: how many errors of the sample a pair must lie above the threshold for a node to take it for a link; links don't depend on it."""

    per_cent: int = 85
    trees: int = TREES
    leaf: int = LEAF
    depth: int = DEPTH
    margin: float = 1.0


def wave(classes: DataFrame, labels: DataFrame | None, trees: range, how: How, doubtful: DataFrame | None, again: bool) -> DataFrame:
    """(a, b, firm): the pairs to confirm from ``trees``, across the components of ``labels``; ``again``: in nodes with a doubtful class."""
    with temporary(classes.sparkSession) as keep:
        return keep(stored(_wave(classes, labels, trees, how, doubtful, again), "pairs"))


def _wave(classes: DataFrame, labels: DataFrame | None, trees: range, how: How, doubtful: DataFrame | None, again: bool) -> DataFrame:
    threshold = how.per_cent / 100
    info, tokens = classes.select("key", "n", "sketch", "fine"), classes.select("key", "tokens")
    info = info.withColumn("doubt", F.lit(False)) if doubtful is None else info.join(doubtful.select("key", F.lit(True).alias("doubt")), "key", "left").fillna({"doubt": False})
    at, found = grown(tokens, threshold, trees), []
    if again:  # the few nodes of doubtful classes; stored, so that Spark sees their size
        nodes = grown(tokens.join(doubtful, "key", "left_semi"), threshold, trees).select("node").distinct()
        at = at.join(stored(nodes, "doubt-nodes"), "node", "left_semi")
    for level in range(how.depth):
        now = at.withColumn("part", F.col("key")) if labels is None else at.join(labels, "key", "left").select("node", "key", F.coalesce("root", "key").alias("part"))
        mixed = now.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
        if again and level:
            mixed = mixed.join(now.join(doubtful, "key", "left_semi").select("node").distinct(), "node", "left_semi")
        now = stored(now.join(mixed.select("node", "size"), "node"), "level")
        found.append(in_nodes(now.where(F.col("size") <= how.leaf).join(info, "key"), how.per_cent, how.margin))
        large = now.where(F.col("size") > how.leaf)
        if is_empty(large):
            break
        if level == how.depth - 1:
            found.append(in_nodes(blocks(large, how.leaf).join(info, "key"), how.per_cent, how.margin))
        else:
            at = grown(large.select("node", "key").join(tokens, "key"), threshold)
    return reduce(DataFrame.union, found).groupBy("a", "b").agg(F.max("firm").alias("firm"))


def linked(docs: DataFrame, classes: DataFrame, how: How) -> DataFrame | None:
    """Labels of the classes that have a link, as :func:`components` gives them."""
    links, labels, doubtful = None, None, None
    waves = [(range(min(FIRST, how.trees)), False), (range(min(FIRST, how.trees), how.trees), False)]
    while waves:
        trees, again = waves.pop(0)
        pairs = wave(classes, labels, trees, how, doubtful, again)
        if is_empty(pairs):
            continue
        with temporary(docs.sparkSession) as keep:
            more = keep(stored(confirmed(pairs, docs, how.per_cent), "links"))
        if not is_empty(more):
            links = more if links is None else links.union(more)
            labels = components(links)
        failed = stored(pairs.where("firm").join(more, ["a", "b"], "left_anti"), "failed")
        if not is_empty(failed):
            keys = failed.select(F.explode(F.array("a", "b")).alias("key"))
            doubtful = stored((keys if doubtful is None else keys.union(doubtful)).distinct(), "doubtful")
            waves = [x for x in waves if not x[1]] + [(range(how.trees), True)]
    return labels


def classes_and_labels(docs: DataFrame, keys: list[str], how: How) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows as :func:`keyed` gives them, classes, labels or None) of ``docs`` with row keys.

    ``own`` of a class is its first row by (doc_id, mark), null ids last."""
    small_batches(docs.sparkSession)
    rows = stored(keyed(docs, keys), "keyed")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "mark", "file", "place")).alias("own")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), own, *[F.first(c).alias(c) for c in ("n", "tokens", "sketch", "fine")])
    classes = stored(classes, "classes")
    return rows.select("file", "place", "doc_id", "n", "key"), classes, linked(docs.select("text"), classes, how)


def rooted(classes: DataFrame, labels: DataFrame | None, columns: list[str]) -> DataFrame:
    """``columns`` of the classes, with the root of each one's component."""
    if labels is None:
        return classes.select(*columns, F.col("key").alias("root"))
    return classes.select("key", *(c for c in columns if c != "key")).join(labels, "key", "left").select(*columns, F.coalesce("root", "key").alias("root"))


def near_duplicates(docs: DataFrame, per_cent: int = 85, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH, margin: float = 1.0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; stored, with all that it was made from removed."""
    with temporary(docs.sparkSession) as keep:
        named, keys = row_keyed(docs.select("doc_id", "text"), "documents")
        rows, classes, labels = classes_and_labels(named, keys, How(per_cent, trees, leaf, depth, margin))
        up = rooted(classes, labels, ["key", "rep"])
        of = up.select("key", "root").join(up.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "component_id")
        some = rows.where("key is not null").select("doc_id", "n", "key").join(of, "key").select("doc_id", "n", "component_id")
        every = some.union(rows.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
        return keep(stored(every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "components"))


def deduplicated(docs: DataFrame, per_cent: int = 85, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """The rows of ``docs`` that stay: the first of each component by (doc_id, text's hash), null ids last; of rows
    equal in both, one. Rows without words stand alone and all stay."""
    named, keys = row_keyed(docs, "documents")
    with temporary(docs.sparkSession) as keep:
        rows, classes, labels = classes_and_labels(named, keys, How(per_cent, trees, leaf, depth))
        first = rooted(classes, labels, ["own"]).groupBy("root").agg(F.min("own").alias("own")).select("own.file", "own.place")
        stay = keep(stored(first.union(rows.where("key is null").select("file", "place")), "kept"))
    return joined_back(named, stay.select(*[F.col(c).alias(k) for c, k in zip(("file", "place"), keys, strict=True)]), keys, "left_semi")


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)


QUERIES = {"op7_chosen_path": op7_chosen_path}
ORACLES: dict[str, str] = {}
