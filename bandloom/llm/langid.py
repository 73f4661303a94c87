"""Language identification by compression.

Texts are normalised first: lower case, runs of anything but letters are one space, and each
distinct word stays where it first occurs (else a line repeated a thousand times outweighs
the rest). For each language the training rows give a raw-content zstandard dictionary: whole
texts, one after another, up to ``dict_bytes``. A text is compressed, block by block to its
end, once with each dictionary; the language whose dictionary gives the fewest bytes is its
language. The margin between the best and the next, as a share of the next, says how sure
that is: ``accepted`` is false where it is below ``margin``.

The sample for the dictionaries is the one bounded part: up to ``DICT_TEXTS`` distinct training texts
for each language, chosen by a hash of the text over the whole table; every row is predicted.
The dictionaries together have at most ``ALL_BYTES``, whatever the number of languages.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any
labelled training row every text is; equal sizes go to the language with most training rows,
then the first by code point; rows with null lang train nothing; ids, null or shared, make no difference to training, and
copies train once; repeated rows are rows of their own; an empty table gives
an empty result; extra columns pass through, replaced where they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, held_out, named, text_udf, without

DICT_BYTES = 32 << 10
ALL_BYTES = 8 << 20
DICT_TEXTS = 200
BLOCK = 4096
#: zstandard's lazy strategy with short matches
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 4}
MARGIN = 0.02
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    return " ".join(dict.fromkeys(_OTHER.sub(" ", text.lower()).split())).encode("utf-8", "replace")


def training_texts(train: DataFrame, texts: int, max_bytes: int) -> list[tuple[str, bytes]]:
    """Up to ``texts`` distinct texts of each language, chosen by a hash of the text; longest first cut off where a text alone would fill a dictionary.

    The share that a first draw takes comes from the number of distinct texts, so neither copies nor ids, null ids or one
    id for all, decide whether a language has a dictionary.
    """
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text", F.lit(17)))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(2.5 * texts) / F.greatest("_n", F.lit(1)))
    draw = F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) / float(1 << 30)
    # a row for each language; of a text no more than four times what fills a dictionary
    some = rows.join(F.broadcast(counts), "lang").where(draw < share).select("lang", "_h", F.octet_length("text").alias("_b"), F.substring("text", 1, 4 * max_bytes).alias("text")).dropDuplicates(["lang", "_h"])
    order = Window.partitionBy("lang").orderBy(F.col("_b") > max_bytes // 8, "_h")
    few = some.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= texts)
    return [(r[0], plain(r[1])[:max_bytes]) for r in few.orderBy("lang", "_k").select("lang", "text").collect()]


def dictionaries(train: DataFrame, dict_bytes: int = DICT_BYTES, texts: int = DICT_TEXTS) -> dict[str, bytes]:
    """lang -> dictionary content, the languages with most rows first."""
    counts = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count().collect()  # a row for each language
    size = max(1, min(dict_bytes, ALL_BYTES // max(1, len(counts))))
    out: dict[str, bytes] = {}
    for lang, text in training_texts(train, texts, size):
        have = out.get(lang, b"")
        if len(have) < size:
            out[lang] = (have + b"\n" + text)[:size]
    rows = dict(map(tuple, counts))
    return dict(sorted(out.items(), key=lambda x: (-rows[x[0]], x[0])))


_packers: dict[int, list[tuple[str, object]]] = {}


def packers(content: dict[str, bytes]) -> list[tuple[str, object]]:
    key = hash(tuple(content.items()))
    if key not in _packers:
        _packers.clear()
        made = []
        params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        for lang, data in content.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress))
        _packers[key] = made
    return _packers[key]


def classify(data: bytes, by: list[tuple[str, object]]) -> tuple[str, float]:
    """(language, margin): compressed sizes summed over blocks of the whole text."""
    if not by:
        return "und", 0.0
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(pack(b)) for b in blocks), k) for k, (_, pack) in enumerate(by))
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
    return by[sizes[0][1]][0], margin


def predict(docs: DataFrame, content: dict[str, bytes], columns: list[str], margin: float = MARGIN) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred, score (the margin, 0 to 1) and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(content)  # ALL_BYTES at most

    def run(texts: Iterator[list[bytes | None]]) -> Iterator[list[dict]]:
        by = packers(shared.value)
        for batch in texts:
            out = []
            for data in batch:
                t = None if data is None else data.decode("utf-8", "replace")
                lang, score = ("und", 0.0) if t is None or not has_letter(t) else classify(plain(t), by)
                out.append({"lang_pred": lang, "score": score, "accepted": lang != "und" and score >= margin})
            yield out

    own = fresh(docs, "_said")
    columns = [c for c in without(docs, ["lang_pred", "score", "accepted"]) if c in columns]
    said = text_udf(run, "struct<lang_pred: string, score: double, accepted: boolean>")
    return docs.withColumn(own, said("text")).select(*named(columns), f"{own}.*")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    content = dictionaries(docs.where("not held_out"))
    return predict(docs, content, ["doc_id", "held_out"])


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
