"""Which samples of an event are analysed, and how they are fetched from the table of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in seconds: analysed at most, before the start, at least, and how late an end is noticed.
DWELL_S, PRE_S, LEAST_S, HANG_S = 0.9, 0.3, 0.12, 0.30


def ranges(events: DataFrame, rate: float, dwell_s: float = DWELL_S, pre_s: float = PRE_S, least_s: float = LEAST_S, hang_s: float = HANG_S) -> DataFrame:
    """``events`` (start, end, written: sample numbers) with ``first`` and ``length`` of what is analysed, once for each event.

    A full excerpt as soon as so many samples are there; where the event ends before that,
    what it has; nothing (null) while it is open and short, or too short to measure. ``end``
    is null while an event is open; ``written`` counts the samples so far.
    """

    def n(seconds: float) -> Column:
        return F.lit(round(seconds * rate)).cast("long")

    first = F.greatest(F.col("start") - n(pre_s), F.lit(0))
    full, rest = n(dwell_s + pre_s), F.col("end") - F.col("first")
    there = F.coalesce(F.col("end") + n(hang_s), F.col("written"))
    length = F.when(there >= F.col("first") + full, full).when(F.col("end").isNotNull(), F.least(rest, full))
    out = events.withColumn("first", first.cast("long")).withColumn("_n", length)
    return out.withColumn("length", F.when(F.col("_n") >= n(least_s), F.col("_n")).cast("long")).drop("_n")


def fetched(wanted: DataFrame, frames: DataFrame, frame_n: int) -> DataFrame:
    """``wanted`` (id, receiver_id, window_id, first, length) with the samples ``i`` and ``q`` of that range.

    Frames hold ``frame_n`` samples each, frame k from ``k * frame_n`` on; a range meets its
    own frames only. Null where a frame is missing (aged out, or not there yet). An excerpt
    is about a second long, so a row stays small.
    """
    last = F.col("first") + F.col("length") - 1
    need = F.expr(f"sequence(first div {frame_n}, (first + length - 1) div {frame_n})")
    each = wanted.where("length > 0").select("id", "receiver_id", "window_id", F.explode(need).alias("frame_no"))
    met = each.join(frames.select("receiver_id", "window_id", "frame_no", "i", "q"), ["receiver_id", "window_id", "frame_no"])
    parts = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "i", "q"))).alias("_p"))
    whole = wanted.join(parts, "id", "left")
    count = F.floor(last / frame_n) - F.floor(F.col("first") / frame_n) + 1
    at = (F.col("first") % frame_n + 1).cast("int")

    def cut(c: str) -> Column:
        return F.when(F.size("_p") == count, F.slice(F.flatten(F.transform("_p", lambda x: x[c])), at, F.col("length").cast("int")))

    return whole.withColumns({"i": cut("i"), "q": cut("q")}).drop("_p")
