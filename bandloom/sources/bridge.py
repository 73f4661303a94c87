"""Domain tables made from the driver's tables: signal events, a band plan, coverage windows.

The same projections stand here as DataFrames and as SQL, so that every query has an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_HZ, STEP_HZ, OFFSET_HZ = 462_550_000, 25_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a band of 40 bins, with gaps, contested tones and unanalysed rows."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id AS id", "unix_micros(cast(ts AS timestamp)) AS t_us", "if(user_id % 3 = 0, 'vhf', 'uhf') AS receiver_id",
        f"{BASE_HZ} + ((user_id * 7 + event_id % 5) % 40) * 6250 + (event_id % 7 - 3) * 100 AS freq_hz", "if(event_id % 97 = 0, null, value) AS duration_s",
        "cast(8 + event_id % 40 AS double) AS snr_db", "if(event_id % 11 = 0, null, cast(2000 + (user_id % 5) * 700 + event_id % 13 AS double)) AS deviation_hz",
        "CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN user_id % 5 < 2 THEN 'ctcss' WHEN user_id % 5 = 2 THEN 'dcs' WHEN user_id % 5 = 3 THEN 'none' WHEN event_id % 2 = 0 THEN 'none' ELSE 'ctcss' END AS tone_state",
        "CASE WHEN event_id % 10 = 0 THEN null WHEN user_id % 5 = 0 THEN 141.3D WHEN user_id % 5 = 1 THEN if(event_id % 3 = 0, 67.0D, 100.0D) WHEN user_id % 5 = 4 AND event_id % 2 = 1 THEN 88.5D END AS ctcss_hz",
        "if(user_id % 5 = 2 AND event_id % 10 <> 0 AND event_id % 4 < 3, 155, cast(null AS int)) AS dcs_code", "if(user_id % 5 = 2, 'N', null) AS dcs_polarity",
        "'fm' AS modulation", "CASE WHEN event_id % 3 = 0 THEN 'voice' WHEN event_id % 7 = 0 THEN 'data' END AS content", "event_id % 2 AS overload", "event_id % 4 AS run_id",
    )


SIG_SQL = f"""sig AS (
  SELECT event_id AS id, epoch_us(ts) AS t_us, CASE WHEN user_id % 3 = 0 THEN 'vhf' ELSE 'uhf' END AS receiver_id,
    {BASE_HZ} + ((user_id * 7 + event_id % 5) % 40) * 6250 + (event_id % 7 - 3) * 100 AS freq_hz, CASE WHEN event_id % 97 <> 0 THEN value END AS duration_s,
    CAST(8 + event_id % 40 AS DOUBLE) AS snr_db, CASE WHEN event_id % 11 <> 0 THEN CAST(2000 + (user_id % 5) * 700 + event_id % 13 AS DOUBLE) END AS deviation_hz,
    CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN user_id % 5 < 2 THEN 'ctcss' WHEN user_id % 5 = 2 THEN 'dcs' WHEN user_id % 5 = 3 THEN 'none' WHEN event_id % 2 = 0 THEN 'none' ELSE 'ctcss' END AS tone_state,
    CAST(CASE WHEN event_id % 10 = 0 THEN null WHEN user_id % 5 = 0 THEN 141.3 WHEN user_id % 5 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 67.0 ELSE 100.0 END WHEN user_id % 5 = 4 AND event_id % 2 = 1 THEN 88.5 END AS DOUBLE) AS ctcss_hz,
    CASE WHEN user_id % 5 = 2 AND event_id % 10 <> 0 AND event_id % 4 < 3 THEN 155 END AS dcs_code, CASE WHEN user_id % 5 = 2 THEN 'N' END AS dcs_polarity,
    'fm' AS modulation, CASE WHEN event_id % 3 = 0 THEN 'voice' WHEN event_id % 7 = 0 THEN 'data' END AS content, event_id % 2 AS overload, event_id % 4 AS run_id
  FROM events)"""


def plan(spark: SparkSession) -> DataFrame:
    """Ten channels in two services of equal windows, one enclosing segment, one overlap; the tail is unallocated."""
    k = spark.range(10)
    center = F.lit(BASE_HZ) + F.col("id") * STEP_HZ
    channel = [(center - 6250).alias("freq_lo_hz"), (center + 6249).alias("freq_hi_hz"), center.alias("freq_center_hz")]
    gmrs = k.select((F.col("id") + 1).alias("id"), *channel, F.lit(20_000).cast("long").alias("bandwidth_hz"), F.lit("gmrs").alias("service"), F.concat(F.lit("GMRS "), F.col("id") + 1).alias("label"),
                    F.lit("channel").alias("kind"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("is_repeater_out"), F.when(F.col("id") % 2 == 0, F.lit(OFFSET_HZ)).cast("long").alias("pair_offset_hz"), F.lit(1).alias("licensed"))
    frs = k.where("id < 6").select((F.col("id") + 101).alias("id"), *channel, F.lit(12_500).cast("long").alias("bandwidth_hz"), F.lit("frs").alias("service"), F.concat(F.lit("FRS "), F.col("id") + 1).alias("label"),
                                   F.lit("channel").alias("kind"), F.lit(0).alias("is_repeater_out"), F.lit(None).cast("long").alias("pair_offset_hz"), F.lit(0).alias("licensed"))
    wide = spark.range(2).select(
        (F.col("id") + 201).alias("id"), (F.lit(BASE_HZ - 10_000) + F.col("id") * 150_000).alias("freq_lo_hz"), (F.lit(BASE_HZ + 149_999) + F.col("id") * 40_000).alias("freq_hi_hz"), F.lit(None).cast("long").alias("freq_center_hz"),
        F.lit(None).cast("long").alias("bandwidth_hz"), F.lit("land").alias("service"), F.concat(F.lit("segment "), F.col("id") + 1).alias("label"), F.lit("segment").alias("kind"), F.lit(0).alias("is_repeater_out"), F.lit(None).cast("long").alias("pair_offset_hz"), F.lit(1).alias("licensed"),
    )
    return gmrs.unionByName(frs).unionByName(wide)


PLAN_SQL = f"""k AS (SELECT range AS id, {BASE_HZ} + range * {STEP_HZ} AS c FROM range(10)), plan AS (
  SELECT id + 1 AS id, c - 6250 AS freq_lo_hz, c + 6249 AS freq_hi_hz, c AS freq_center_hz, 20000 AS bandwidth_hz, 'gmrs' AS service, 'GMRS ' || (id + 1) AS label, 'channel' AS kind,
    CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS is_repeater_out, CASE WHEN id % 2 = 0 THEN {OFFSET_HZ} END AS pair_offset_hz, 1 AS licensed FROM k
  UNION ALL SELECT id + 101, c - 6250, c + 6249, c, 12500, 'frs', 'FRS ' || (id + 1), 'channel', 0, NULL, 0 FROM k WHERE id < 6
  UNION ALL SELECT range + 201, {BASE_HZ - 10_000} + range * 150000, {BASE_HZ + 149_999} + range * 40000, NULL, NULL, 'land', 'segment ' || (range + 1), 'segment', 0, NULL, 1 FROM range(2))"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage window for each receiver and day of the events; each third one is still open."""
    s = sig(spark, sf_dir).withColumn("day", F.expr("t_us div 86400000000"))
    w = s.groupBy("run_id", "receiver_id", "day").agg(F.min("t_us").alias("t_start_us"), F.max("t_us").alias("last_us"))
    w = w.withColumn("id", F.expr("day * 100 + run_id * 10 + if(receiver_id = 'vhf', 1, 0)"))
    return w.select("id", "run_id", "receiver_id", F.expr(f"{BASE_HZ} + day % 3 * 1000000").alias("center_hz"), F.when(F.col("day") % 5 < 4, F.concat(F.lit("w"), F.col("day") % 5)).alias("label"), "t_start_us", F.when(F.col("day") % 3 != 0, F.col("last_us")).alias("t_end_us"), "day")


WINDOWS_SQL = f"""win AS (
  SELECT day * 100 + run_id * 10 + CASE WHEN receiver_id = 'vhf' THEN 1 ELSE 0 END AS id, run_id, receiver_id, {BASE_HZ} + day % 3 * 1000000 AS center_hz, CASE WHEN day % 5 < 4 THEN 'w' || (day % 5) END AS label,
    t_start_us, CASE WHEN day % 3 <> 0 THEN last_us END AS t_end_us, day
  FROM (SELECT run_id, receiver_id, t_us // 86400000000 AS day, min(t_us) AS t_start_us, max(t_us) AS last_us FROM sig GROUP BY ALL))"""
