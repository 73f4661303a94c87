"""Radio tables made from the driver's tables, so that they grow with them: frames of channel power as the events measured it, samples, signals.

Everything follows from a row's numbers, so a lost task makes the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp, golay
from ..session import BATCH_BYTES
from .bridge import table

CHANNELS, FRAME_S, QUIET_DB = 40, 0.12, -90.0
DAY_US, FRAME_US = 86_400_000_000, 600_000_000
EVENTS_PER_WINDOW, RECEIVERS = 200, 2
RATE_HZ, CENTER_HZ, SIGNAL_RATE_HZ, OFFSET_HZ = 250_000.0, 466_000_000, 50_000.0, 12_500.0


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receiver_id, window_id, frame_no, frame_start, at, power_db, wideband_db, clip_frac): what the events' table measured, as a spectrum over time.

    A frame is ``FRAME_US`` of the table's time, a window a day, a channel the users alike modulo ``CHANNELS``; its
    power is the sum of their values over the quiet level. Frames without an event are quiet.
    """
    e = table(spark, sf_dir, "events").selectExpr("user_id % 2 AS rx", f"user_id div 2 % {CHANNELS} AS ch", "unix_micros(cast(ts AS timestamp)) AS t_us", "value")
    e = e.withColumn("window_id", F.expr(f"t_us div {DAY_US}")).withColumn("frame_no", F.expr(f"t_us % {DAY_US} div {FRAME_US}"))
    by = ["rx", "window_id", "frame_no"]
    heard = e.groupBy(*by, "ch").agg(F.sum("value").alias("v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ch", "v"))).alias("on"))  # CHANNELS entries at most
    every = e.select("rx", "window_id").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DAY_US // FRAME_US - 1).cast("long"))).alias("frame_no"))
    level = F.transform(F.sequence(F.lit(0), F.lit(CHANNELS - 1)), lambda c: QUIET_DB + F.coalesce(F.try_element_at("on", c.cast("long")), F.lit(0.0)))
    out = every.join(heard, by, "left").withColumn("power_db", level).withColumn("frame_start", F.col("window_id") * DAY_US + F.col("frame_no") * FRAME_US)
    return out.select(
        F.concat(F.lit("rx"), "rx").alias("receiver_id"), "window_id", "frame_no", "frame_start", F.timestamp_micros("frame_start").alias("at"), "power_db",
        ((F.array_sort("power_db")[CHANNELS // 2 - 1] + F.array_sort("power_db")[CHANNELS // 2]) / 2).alias("wideband_db"), F.lit(0.0).alias("clip_frac"),
    )


def sliced(batches: Iterator[pd.DataFrame], samples: int) -> Iterator[pd.DataFrame]:
    """Rows that are made into so many samples (two floats) each, few enough at a time to fill an Arrow batch."""
    n = max(1, BATCH_BYTES // (8 * samples))
    for b in batches:
        for k in range(0, len(b), n):
            yield b.iloc[k : k + n]


def samples(spark: SparkSession, sf_dir: str, nfft: int = 1024) -> DataFrame:
    """A frame of samples for each supplier: a carrier on one of the channels, in noise."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("station")).repartition(spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(4 * nfft) / RATE_HZ
        for b in sliced(batches, len(t)):
            rows = []
            for station in b["station"]:
                rng = np.random.default_rng(int(station))
                x = np.exp(2j * np.pi * 6250 * (int(station) % 31 - 15) * t) + 0.05 * (rng.normal(size=len(t)) + 1j * rng.normal(size=len(t)))
                rows.append((f"rx{station % RECEIVERS}", station // EVENTS_PER_WINDOW, CENTER_HZ, station, station * len(t), x.real.astype(np.float32), x.imag.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["receiver_id", "window_id", "center_hz", "frame_no", "frame_start", "i", "q"])

    return e.mapInPandas(run, "receiver_id string, window_id long, center_hz long, frame_no long, frame_start long, i array<float>, q array<float>")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, kind, iq, rate, offset): a second of FM for each supplier, with a tone, a code, neither, or too short for either."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("station"), F.col("s_acctbal").cast("double").alias("balance"))
    kinds = ("tone", "code", "plain", "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(int(SIGNAL_RATE_HZ * 1.1)) / SIGNAL_RATE_HZ
        voices, bit = np.sin(2 * np.pi * 700 * t) + np.sin(2 * np.pi * 1130 * t), (t * dsp.BAUD).astype(int) % 23
        for b in sliced((b.to_pandas() for b in batches), len(t)):
            rows = []
            for station, balance in zip(b["station"], b["balance"], strict=True):
                kind = kinds[station % 4]
                n = int(SIGNAL_RATE_HZ * 0.3) if kind == "short" else len(t)
                inst = (1500 + abs(balance) % 3000 - 600) / 2 * voices[:n]
                if kind == "tone":
                    inst = inst + 600 * np.sin(2 * np.pi * dsp.TONES[station % len(dsp.TONES)] * t)
                elif kind == "code":
                    word = golay.plain_word(golay.CODES[station % len(golay.CODES)])
                    inst = inst + 600 * (2.0 * (word >> bit & 1) - 1)
                rng = np.random.default_rng(int(station))
                phase = 2 * np.pi * (OFFSET_HZ * t[:n] + np.cumsum(inst) / SIGNAL_RATE_HZ)
                iq = np.empty(n, np.complex64)
                iq.real, iq.imag = np.cos(phase) + 0.05 * rng.standard_normal(n), np.sin(phase) + 0.05 * rng.standard_normal(n)
                rows.append((station, kind, iq.tobytes(), SIGNAL_RATE_HZ, OFFSET_HZ))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["station", "kind", "iq", "rate", "offset"]), preserve_index=False)

    return s.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "station long, kind string, iq binary, rate double, offset double")
