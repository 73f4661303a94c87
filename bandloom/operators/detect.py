"""Detection as window functions: local maxima, run lengths, hysteresis, floors and flags.

The recursive form, where the floor depends on the detector, is in ``streaming.detector``;
here levels are given. A key's rows are cut into parts, so one key may hold any share of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ordered import PART, PLACE, Ordered, medians, sliding


def local_maxima(grid: DataFrame, frame: str, channel: str, value: str) -> DataFrame:
    """Rows at least as high as both neighbours of their frame; ends have no neighbour, ties stay."""
    by = Window.partitionBy(frame).orderBy(channel)
    low = F.lit(float("-inf"))
    rows = grid.withColumn("_l", F.coalesce(F.lag(value).over(by), low)).withColumn("_r", F.coalesce(F.lead(value).over(by), low))
    return rows.where((F.col(value) >= F.col("_l")) & (F.col(value) >= F.col("_r"))).drop("_l", "_r")


def run_lengths(frames: DataFrame, key: str, order: list[str], hot: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows in a row, this one included, satisfy ``hot``; 0 where it fails."""
    o = Ordered(frames, [key], order)
    return o.runs(o.rows, {name: hot}).drop(PART, PLACE)


def tracked(frames: DataFrame, key: str, order: list[str], value: str, start: str, on: float, off: float, least: int, hang: int, may_start: Column | None = None) -> DataFrame:
    """Events (key, event_no, start, end, peak) of each key's frames.

    On after ``least`` rows in a row at or above ``on`` (and ``may_start``), off after ``hang``
    rows in a row below ``off``; both edges are set back to where their run began. The last
    trigger is the state. The peak counts rows that are on. An event still on has no end.
    """
    o = Ordered(frames, [key], order)
    rows = o.runs(o.rows, {"_above": F.col(value) >= on, "_below": F.col(value) < off})
    gate = F.lit(True) if may_start is None else may_start
    trigger = F.when((F.col("_above") >= least) & gate, 1).when(F.col("_below") >= hang, 0)
    rows = o.lagged(o.latest(rows, "_on", trigger, F.lit(0)), start, {"_up": least - 1, "_down": hang - 1})
    opened, closed = (F.col("_on") == 1) & (F.col("_on_before") == 0), (F.col("_on") == 0) & (F.col("_on_before") == 1)
    rows = o.running(rows, {"event_no": F.when(opened, 1).otherwise(0)}).where((F.col("_on") == 1) | (F.col("_on_before") == 1))
    return rows.groupBy(key, "event_no").agg(F.min(F.when(opened, F.col("_up"))).alias("start"), F.min(F.when(closed, F.col("_down"))).alias("end"), F.max(F.when(F.col("_on") == 1, F.col(value))).alias("peak"))


def rolling_floor(frames: DataFrame, key: str, order: list[str], value: str, history: int = 120, warm: int = 20, part: float = 0.25) -> DataFrame:
    """Adds ``floor``: the k-th smallest of the last ``history`` values, k a quarter of a full history, no higher than the last; null until ``warm``."""
    k = int(history * part)
    return sliding(frames, [key], order, value, history, "floor", DoubleType(), lambda w: w[min(k, len(w) - 1)] if len(w) >= warm else None)


def percentile_of(values: list[float], part: float) -> float:
    """Between the two values next to that part of the way through a sorted list.

    Levels just as far above it as the limit depend on its last bit, so it is rounded as DuckDB's quantile_cont rounds: the lower share is added unrounded.
    """
    at = part * (len(values) - 1)
    k = int(at)
    if at == k or values[k] == values[k + 1]:
        return values[k]
    lower, upper = 1 - (at - k), values[k + 1] * (at - k)
    return math.fma(values[k], lower, upper) if math.isfinite(values[k]) and math.isfinite(upper) else lower * values[k] + upper


def overload_flags(frames: DataFrame, key: str, order: list[str], level: str, clip: str, history: int = 300, warm: int = 60, desense: float = 6.0, clipped: float = 1e-4) -> DataFrame:
    """Adds ``baseline`` (20th percentile of the last levels, none until warm) and ``overload`` 0/1."""
    rows = sliding(frames, [key], order, level, history, "baseline", DoubleType(), lambda w: percentile_of(w, 0.2) if len(w) >= warm else None)
    return rows.withColumn("overload", (F.coalesce(F.col(level) - F.col("baseline") > desense, F.lit(False)) | F.coalesce(F.col(clip) > clipped, F.lit(False))).cast("int"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of events less than ``gap`` apart, by the session window."""
    w = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("start"), "n")


def spectrum_snapshot(grid: DataFrame, channel: str, value: str) -> DataFrame:
    """Per channel the mean and peak over frames, and the peak above the median of the channels' medians."""
    each = grid.groupBy(channel).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"))
    middle = medians(grid, [channel], {"_m": F.col(value)})  # a row for each channel
    floor = middle.agg(F.median("_m").alias("floor"))
    return each.join(floor).select(channel, "mean", "peak", (F.col("peak") - F.col("floor")).alias("above"))
