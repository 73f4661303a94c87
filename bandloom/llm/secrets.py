"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (sha256). The ledger is a Parquet table
of (blob, rules, ...findings) with a row for each blob and rule version already scanned. A
run takes the hashes of all its paths, leaves out those the ledger has under the present rule
version, fetches one copy of each unseen blob by its row, scans it once, appends to the ledger,
and joins the findings of its own blobs to all paths.

Only hashes and row keys are grouped and compared, so a blob that a third of all paths share is
no hot spot; texts of known blobs are hashed where they are read and go no further, and a run
that meets nothing new reads no text again. The result is stored; the hashes and unseen rows
that it was made from are removed.

Defined results: null text is the empty text; a null path keeps its row; repeated rows are
rows of their own; an empty table gives an empty result; other columns of the input are not
returned, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import is_empty, path_exists, row_keyed, scratch_path, small_batches, stored, temporary, text_or_empty

#: Fixed patterns over UTF-8 bytes. The first three are the base; the others add spans.
#: (kind, pattern, group that must have so many bytes, how many, text it can't do without)
RULES = (
    ("assign", rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6, None),
    ("access", rb"AKIA[A-Z0-9]+", 0, 20, b"AKIA"),
    ("hex", rb"[0-9a-f]{24,}", 0, 24, None),
    ("pem", rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0, b"-----BEGIN "),
    ("github", rb"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, b"gh"),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, b"xox"),
    ("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, b"eyJ"),
)
BASE = ("assign", "access", "hex")
ORDER = {kind: k for k, (kind, *_) in enumerate(RULES)}
RULES_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
_COMPILED = [(kind, re.compile(p), group, least, mark) for kind, p, group, least, mark in RULES]
_PLAIN = np.array([(b & 0xC0) != 0x80 for b in range(256)])

LEDGER = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def spans_in(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; leftmost matches of each kind."""
    found = []
    for kind, pattern, group, least, mark in _COMPILED:
        if mark is None or mark in data:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(data) if m.end(group) - m.start(group) >= least]
    if found and len(data) != len(data.decode("utf-8", "replace")):
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_PLAIN[np.frombuffer(data, np.uint8)], out=points[1:])
        found = [(k, int(points[s]), int(points[e])) for k, s, e in found]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def as_line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [spans_in(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        base = [[s for s in r if s[0] in BASE] for r in rows]
        count = [pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE]
        digest = pa.array([hashlib.sha256(as_line(r).encode()).hexdigest() for r in base])
        rules = pa.array([RULES_VERSION] * len(rows), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("blob"), rules, *count, digest, pa.array([as_line(r) for r in rows], pa.string())], names=[c.split()[0] for c in LEDGER.split(", ")])


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None where there is none yet."""
    return spark.read.schema(LEDGER).parquet(path) if path_exists(spark, path) else None


def scan_history(versions: DataFrame, ledger_path: str, path_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Findings for every (path, version): (path, blob, n_assign, n_access, n_hex, base_sha256, spans)."""
    spark = versions.sparkSession
    small_batches(spark)
    with temporary(spark) as keep:
        named, keys = row_keyed(versions.select(F.col(path_column).alias("path"), F.col(text_column).alias("text")), "versions")
        hashed = named.select(*keys, "path", F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("blob"))
        paths = stored(hashed.select(F.struct(*keys).alias("row"), "path", "blob"), "paths")
        blobs = paths.groupBy("blob").agg(F.min("row").alias("row"))
        ledger = read_ledger(spark, ledger_path)
        if ledger is not None:
            blobs = blobs.join(ledger.where(F.col("rules") == RULES_VERSION), "blob", "left_anti")
        unseen = stored(blobs.select("row.*", "blob"), "unseen")
        if ledger is None or not is_empty(unseen):
            texts = named.join(unseen, keys).select("blob", text_or_empty().alias("text"))
            texts.mapInArrow(_scan, LEDGER).write.mode("append").parquet(ledger_path)
        # an interrupted append may have left a blob twice; its rows are equal. Stored, so that Spark can split a hot blob's paths in the join
        known = read_ledger(spark, ledger_path).where(F.col("rules") == RULES_VERSION).join(paths.select("blob"), "blob", "left_semi")
        present = stored(known.dropDuplicates(["blob"]).drop("rules"), "findings")
        return keep(stored(paths.select("path", "blob").join(present, "blob").withColumnRenamed("path", path_column), "by-path"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_history(docs, scratch_path(spark, "secret-ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.lower(F.hex("blob")).alias("blob"))


QUERIES = {"op4_secret_ledger": op4_secret_ledger}
ORACLES: dict[str, str] = {}
