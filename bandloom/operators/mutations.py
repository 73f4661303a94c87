"""Updates on append-only storage: change logs, upserts, cascades and swaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


TONE_STATES = ("none", "ctcss", "dcs", "unknown")


def appended(rows: list[dict] | DataFrame, table: str, spark, path: str) -> None:
    """Appends rows to a table after checking their columns and tone states; unknown columns are refused, missing ones are null.

    A frame is checked where its rows are; a list is for the few rows that a driver has itself.
    """
    spec = schemas.TABLES[table].replace(" not null", "")
    known = {c.strip().split()[0]: c.strip().split()[1] for c in spec.split(",")}
    if not isinstance(rows, DataFrame):
        if extra := {c for row in rows for c in row} - set(known):
            raise ValueError(f"unknown columns: {', '.join(sorted(extra))}")
        rows = spark.createDataFrame([{k: row.get(k) for k in known} for row in rows], spec)
    if extra := set(rows.columns) - set(known):
        raise ValueError(f"unknown columns: {', '.join(sorted(extra))}")
    if "tone_state" in rows.columns:
        bad = rows.where(F.col("tone_state").isNotNull() & ~F.col("tone_state").isin(*TONE_STATES)).select("tone_state").first()
        if bad:
            raise ValueError(f"tone_state {bad[0]!r}")
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()]).write.mode("append").parquet(path)


def latest(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The current row of each key: for every column its last value that is not null."""
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with their key, and all others."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without(parents: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return parents.join(gone.select(key).distinct(), key, "left_anti")


def cascaded(parents: DataFrame, children: DataFrame, key: str, ref: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents without those named in ``gone``, and children without those of a parent that went."""
    dead = gone.select(F.col(key).alias(ref)).distinct()
    return without(parents, gone, key), children.join(dead, ref, "left_anti")


def _files(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def recovered(spark: SparkSession, path: str) -> None:
    """Ends a swap that was stopped half way: the new table if it was written whole, else the old one, is in place again."""
    fs, at = _files(spark, path)
    new, old = _files(spark, f"{path}.new")[1], _files(spark, f"{path}.old")[1]
    if not fs.exists(at):
        if exists(spark, f"{path}.new/_SUCCESS"):
            fs.rename(new, at)
        elif fs.exists(old):
            fs.rename(old, at)
    if fs.exists(at):
        fs.delete(old, True)
        fs.delete(new, True)


def swapped(df: DataFrame, path: str) -> None:
    """Rewrites a derived table: written beside the old one, then moved into its place.

    Whenever it is stopped, one of the two is there whole; :func:`recovered` puts it in place.
    """
    spark = df.sparkSession
    recovered(spark, path)
    fs, at = _files(spark, path)
    new, old = _files(spark, f"{path}.new")[1], _files(spark, f"{path}.old")[1]
    df.write.mode("overwrite").parquet(f"{path}.new")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
