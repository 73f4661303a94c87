"""A folder of tables at one version of the schema: created, changed together, checked, brought up to date.

What the folder holds is said by its newest manifest, a small file that names each table's folder and
the version. A change of any number of tables writes their new folders first and one manifest last,
whose name is taken by renaming: until then readers see the tables as they were, and a change that was
stopped leaves folders that nothing names. Of two changes at once, the second finds its number taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import mutations, views

META = "schema_meta"
MANIFESTS = "_manifests"


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: number, version, and folder by table; a folder without one is at number 0."""
    fs, at = mutations._files(spark, f"{path}/{MANIFESTS}")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
    whole = [n for n in names if n.endswith(".json")]
    if not whole:
        return {"number": 0, "version": None, "tables": {}}
    return json.loads(spark.read.text(f"{path}/{MANIFESTS}/{whole[-1]}", wholetext=True).first()[0])


def folder(spark: SparkSession, path: str, name: str) -> str:
    """Where a table's rows are; rows appended there are seen at once."""
    return f"{path}/{manifest(spark, path)['tables'].get(name, name)}"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(folder(spark, path, name))


def version(spark: SparkSession, path: str) -> int | None:
    """The version that the folder's tables are at; None where there is none yet."""
    now = manifest(spark, path)
    if now["version"] is not None:
        return now["version"]
    if not mutations.exists(spark, f"{path}/{META}"):
        return None
    row = spark.read.parquet(f"{path}/{META}").where("key = 'version'").first()
    return int(row.value) if row else None


def committed(spark: SparkSession, path: str, tables: dict[str, DataFrame], to: int | None = None) -> int:
    """Puts new rows in place of those of all ``tables`` at once, as version ``to``; returns the number of the change."""
    now = manifest(spark, path)
    number, folders = now["number"] + 1, dict(now["tables"])
    for name, df in tables.items():
        folders[name] = f"{name}@{number}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{path}/{folders[name]}")
    text = json.dumps({"number": number, "version": now["version"] if to is None else to, "tables": folders})
    fs, draft = mutations._files(spark, f"{path}/{MANIFESTS}/.{number:08d}-{uuid.uuid4().hex[:8]}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    final = mutations._files(spark, f"{path}/{MANIFESTS}/{number:08d}.json")[1]
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise ValueError(f"{path}: another change was made meanwhile; read it and try again")
    return number


def vacuumed(spark: SparkSession, path: str) -> list[str]:
    """Removes folders of tables that the newest manifest doesn't name; returns their names."""
    fs, at = mutations._files(spark, path)
    named = set(manifest(spark, path)["tables"].values())
    gone = sorted(f.getPath().getName() for f in fs.listStatus(at) if "@" in f.getPath().getName() and f.getPath().getName() not in named)
    for name in gone:
        fs.delete(mutations._files(spark, f"{path}/{name}")[1], True)
    return gone


def broken_references(tables: dict[str, DataFrame]) -> dict[str, int]:
    """(table.column) -> rows whose reference names nothing."""
    out = {}
    for child, columns in schemas.FOREIGN.items():
        for column, (parent, key) in columns.items():
            if child in tables and parent in tables and column in tables[child].columns:
                n = schemas.orphans(tables[child], column, tables[parent], key).count()
                out |= {f"{child}.{column}": n} if n else {}
    return out


def ensure(spark: SparkSession, path: str, to: int = schemas.VERSION) -> int:
    """Creates what is missing and brings the rest to version ``to``; returns the version it found (or ``to``).

    Runs again without harm: tables that are there stay, and a swap of one that was stopped is ended
    first. An older version than the folder's is refused, and so are references that name
    nothing. All that changes does so in one step, with the version.
    """
    at = version(spark, path)
    if at is not None and at > to:
        raise ValueError(f"{path} is at version {at}; {to} is older")
    known, changed = {}, {}
    for name, spec in schemas.tables_at(to).items():
        if name == META:
            continue
        where = folder(spark, path, name)
        mutations.recovered(spark, where)
        if not mutations.exists(spark, where):
            changed[name] = spark.createDataFrame([], spec.replace(" not null", ""))
        else:
            old = known[name] = spark.read.parquet(where)
            new = schemas.migrated(old, name, at, to) if at is not None else old
            if new.columns != old.columns:
                changed[name] = new
    if bad := broken_references(known | changed):
        raise ValueError(f"{path}: references that name nothing: {bad}")
    if changed or at != to:
        meta = spark.range(1).select(F.lit("version").alias("key"), F.lit(str(to)).alias("value"))
        committed(spark, path, changed | {META: meta}, to)
    return at or to


def _timed(df: DataFrame, **columns: str) -> DataFrame:
    """Seconds since 1970 as microseconds, under the names that the views use."""
    return df.withColumns({new: F.round(F.col(old) * 1_000_000).cast("long") for new, old in columns.items()})


def views_of(tables: dict[str, DataFrame], at: int) -> dict[str, DataFrame]:
    """The views that version ``at`` has, over its tables."""
    events, channels, plan = _timed(tables["events"], t_us="t_start").withColumn("key", F.col("channel_id")), tables["channels"].withColumn("key", F.col("id")), tables["band_plan"]
    made = {"v_events": lambda: views.events_view(events, channels, plan), "v_activity": lambda: views.activity(events)}

    def contactable() -> DataFrame:
        first = tables["pairs"].groupBy(F.col("output_channel_id").alias("id")).agg(F.min_by("input_channel_id", "id").alias("input_id"))
        to = tables["channels"].select(F.col("id").alias("input_id"), F.col("freq_hz").alias("input_hz"))
        return views.contactable(tables["channels"].join(first, "id", "left").join(to, "input_id", "left"))

    def coverage() -> DataFrame:
        w = _timed(tables["coverage_windows"], t_start_us="t_start", t_end_us="t_end")
        if at >= 8:
            return views.coverage(w, events)
        n = views.coverage_by_time(w, events)  # events had no window yet
        each = w.join(n, "id").withColumn("listened_us", F.coalesce("t_end_us", "t_start_us") - F.col("t_start_us"))
        return each.groupBy("run_id", "receiver_id", "center_hz").agg(F.count(F.lit(1)).alias("windows"), F.sum("listened_us").alias("listened_us"), F.sum("events").alias("events"))

    made |= {"v_contactable": contactable, "v_coverage": coverage}
    return {name: made[name]() for name, since in schemas.VIEWS.items() if since <= at}


def register_views(spark: SparkSession, path: str) -> list[str]:
    """Makes the folder's views known to SQL, as its version has them; returns their names."""
    at = version(spark, path)
    found = views_of({name: table(spark, path, name) for name in schemas.tables_at(at) if name != META}, at)
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return sorted(found)
