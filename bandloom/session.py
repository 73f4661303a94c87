"""A session with the settings every job here assumes: UTC, adaptive plans, skew handling; and scratch tables with an end."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "bandloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def owned(path: str) -> None:
    """The innermost :func:`temporary` that runs removes ``path`` at its end."""
    if scopes := _scopes.get():
        scopes[-1].append(path)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; our own, one for each context, only where none is set, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="bandloom-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes with the :func:`temporary` that it was made in."""
    path = f"{scratch_dir(spark)}/bandloom/{name}-{uuid.uuid4().hex[:12]}"
    owned(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession):
    """What is stored inside is removed at the end, but for frames handed to the function this yields, which go with the scope around it.

    A job that writes its results inside leaves nothing else behind:

        with temporary(spark):
            enrich.rollup(events, plan).write.parquet(path)
    """
    mine: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    scope = _scopes.set((*_scopes.get(), mine))
    try:
        yield keep
    finally:
        _scopes.reset(scope)
        for path in dict.fromkeys(mine):
            if path in kept:
                owned(path)
            else:
                remove_path(spark, path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that a worker's memory doesn't depend on the rows' sizes; a setting of the user's stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used several times is worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
