"""What happens to events, runs and windows, as rows of change logs that are only ever appended.

A step of a life fills some columns and leaves the others null; ``seq`` puts the steps in
order. :func:`folded` gives the present state. An event that never got its last step (the
receiver stopped) keeps a null end, which is what says that it was in flight. To forget an
event is to append nothing more for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import mutations, signals

START, ANALYSED, CLOSED, CAPTURED = 1, 2, 3, 4
MEASURED = ("deviation_hz", "ctcss_hz", "ctcss_dev_hz", "dcs_code", "dcs_polarity", "dcs_errors", "analyzed_s")


def started(events: DataFrame) -> DataFrame:
    """First step of events (id, run_id, receiver_id, t_start, freq_hz, overload, window_id): in flight, nothing known of a tone."""
    own = events.select("id", "run_id", "receiver_id", "t_start", "freq_hz", "overload", "window_id")
    return own.withColumn("seq", F.lit(START)).withColumn("tone_state", F.lit("unknown"))


def analysed(results: DataFrame) -> DataFrame:
    """The step of an analysis (id, freq_hz and the columns of :func:`signals.analysed`): what was measured, the raw frequency, and the tone's state."""
    raw = F.bround(F.col("freq_hz") + F.col("freq_error_hz")).cast("long")
    return results.select("id", F.lit(ANALYSED).alias("seq"), raw.alias("freq_raw_hz"), *MEASURED, F.col("ctcss_conf").alias("confidence"), signals.tone_state().alias("tone_state"))


def closed(ends: DataFrame) -> DataFrame:
    """The carrier dropped (id, t_end, duration_s, peak_snr)."""
    return ends.select("id", F.lit(CLOSED).alias("seq"), "t_end", "duration_s", F.col("peak_snr").alias("snr_db"))


def captured(files: DataFrame) -> DataFrame:
    """Recordings were written (id, audio_path, iq_path)."""
    return files.select("id", F.lit(CAPTURED).alias("seq"), "audio_path", "iq_path")


def folded(*steps: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The present row of each key: of every column the last value that some step gave it."""
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), steps)
    return mutations.latest(log, key, order, [c for c in log.columns if c not in (key, order)])


def _now(at: float | Column | None) -> Column:
    if isinstance(at, Column):
        return at
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6) if at is None else F.lit(float(at))


def run_started(runs: DataFrame, at: float | Column | None = None) -> DataFrame:
    """Runs (id, host, git_commit, profile_name, profile_yaml, notes) that begin; the profile is kept word for word."""
    return runs.withColumn("seq", F.lit(START)).withColumn("started_at", _now(at))


def run_ended(ids: DataFrame, at: float | Column | None = None) -> DataFrame:
    return ids.select("id", F.lit(CLOSED).alias("seq"), _now(at).alias("ended_at"))


def window_opened(windows: DataFrame, at: float | Column | None = None) -> DataFrame:
    """Windows (id, run_id, receiver_id, center_hz, sample_rate_hz, label) that a receiver begins to listen to."""
    return windows.withColumn("seq", F.lit(START)).withColumn("t_start", _now(at))


def window_closed(ids: DataFrame, at: float | Column | None = None) -> DataFrame:
    return ids.select("id", F.lit(CLOSED).alias("seq"), _now(at).alias("t_end"))


#: what a run knows of a receiver: its identity, how it was set, and where it was tuned to first
RECEIVER = ("id", "run_id", "receiver_id", "serial", "center_hz", "sample_rate_hz", "gain_db")


def registered(receivers: DataFrame) -> DataFrame:
    """Receivers as a run has configured them, a row for each; a column that the table doesn't have is refused, one that is missing is null.

    The serial number is the identity, so it may not be null; the order in which radios are found changes.
    """
    if extra := set(receivers.columns) - set(RECEIVER):
        raise ValueError(f"unknown columns: {', '.join(sorted(extra))}")
    kinds = dict(c.split()[:2] for c in schemas.TABLES["run_receivers"].replace(" not null", "").split(", "))
    out = receivers.select(*[(F.col(c) if c in receivers.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in RECEIVER])
    known = F.when(F.col("serial").isNull(), F.raise_error(F.concat(F.lit("no serial of receiver "), F.coalesce("receiver_id", F.lit("?"))))).otherwise(F.col("serial"))
    return out.withColumn("serial", known.cast("string"))


def standing(runs: DataFrame, windows: DataFrame, receivers: DataFrame) -> DataFrame:
    """Each run's present state: times, receivers, windows, those still open, and seconds listened (an open window has none yet)."""
    heard = windows.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("t_end").isNull()).alias("open"), F.coalesce(F.sum(F.col("t_end") - F.col("t_start")), F.lit(0.0)).alias("listened_s"))
    set_up = receivers.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("receivers"))
    out = runs.join(heard, "id", "left").join(set_up, "id", "left")
    return out.select("id", "started_at", "ended_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("receivers", "windows", "open")], F.coalesce("listened_s", F.lit(0.0)).alias("listened_s"))
