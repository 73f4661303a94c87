"""The detector with its feedback: floors hold still while a channel is active.

Frames (receiver, window_id, frame_no, frame_start, power_db per channel, ...) of one
receiver and window are taken in order. A channel's floor is an order statistic of its last
frames, in which a frame counts with the old floor while the channel is active; so the floor
depends on the detector and the detector on the floor, and neither is a window function.
The state of a key is a few arrays of its channels' width, whatever the length of the stream.
A frame without power says that the receiver has left the window: what is still on ends there,
not closed, and the next frame starts anew. In a stream a key that is silent for ``idle`` is
taken to have left as well.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import scratch

EVENTS = "receiver_id string, window_id long, channel int, start long, end long, peak_snr double, overload int, closed boolean"
LOG = f"{EVENTS}, step string"  # step: open or end
ON_DB, OFF_DB = 10.0, 6.0
HISTORY, WARM, EVERY, PART = 120, 20, 10, 0.25


class Detector:
    """Floors and hysteresis of all channels of one key."""

    def __init__(self, least: int, hang: int):
        self.least, self.hang = least, hang
        self.past: list[np.ndarray] = []
        self.count = 0
        self.floor: np.ndarray | None = None
        self.starts: list[int] = []
        self.opened: list[tuple[int, int, int]] = []
        self.active = self.above = self.below = self.began = self.peak = self.overload = None

    def _floor(self, power: np.ndarray) -> np.ndarray | None:
        if self.floor is not None:
            power = np.where(self.active, self.floor, power)
        self.past = [*self.past[-(HISTORY - 1) :], power]
        self.count += 1
        if len(self.past) >= WARM and (self.floor is None or self.count % EVERY == 0):
            k = min(int(HISTORY * PART), len(self.past) - 1)
            self.floor = np.sort(np.stack(self.past), axis=0)[k]
        return self.floor

    def frame(self, power: np.ndarray, start: int, overload: int = 0) -> list[tuple[int, int, int, float, int, bool]]:
        """Events (channel, start, end, peak, overload, closed) that this frame ends; overload is that of the frame that opened them.

        ``opened`` has those that it begins: (channel, start, overload).
        """
        self.opened = []
        if self.active is None:
            n = len(power)
            self.active, self.above, self.below = np.zeros(n, bool), np.zeros(n, int), np.zeros(n, int)
            self.began, self.peak, self.overload = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n, int)
        floor = self._floor(power)
        if floor is None:
            return []
        snr = power - floor
        self.starts = [*self.starts[-(max(self.least, self.hang) - 1) :], start] if max(self.least, self.hang) > 1 else [start]
        edge = np.r_[-np.inf, snr, -np.inf]
        summit = (snr >= edge[:-2]) & (snr >= edge[2:])
        self.above = np.where(snr >= ON_DB, self.above + 1, 0)
        self.below = np.where(snr < OFF_DB, self.below + 1, 0)
        opens = ~self.active & (self.above >= self.least) & summit
        closes = self.active & (self.below >= self.hang)
        self.began[opens] = self.starts[max(0, len(self.starts) - self.least)]
        self.peak[opens] = -np.inf
        self.overload[opens] = overload
        self.opened = [(int(c), int(self.began[c]), overload) for c in np.flatnonzero(opens)]
        self.active = (self.active | opens) & ~closes
        self.peak = np.where(self.active, np.maximum(self.peak, snr), self.peak)
        end = self.starts[max(0, len(self.starts) - self.hang)]
        return [(int(c), int(self.began[c]), end, float(self.peak[c]), int(self.overload[c]), True) for c in np.flatnonzero(closes)]

    def leave(self, now: int | None = None) -> list[tuple[int, int, int | None, float, int, bool]]:
        """Events still on when the receiver leaves the window: they end now, or at the last frame seen, but are not closed."""
        last = now if now is not None else self.starts[-1] if self.starts else None
        return [] if self.active is None else [(int(c), int(self.began[c]), last, float(self.peak[c]), int(self.overload[c]), False) for c in np.flatnonzero(self.active)]


def settings(frame_s: float, min_s: float = 0.12, hang_s: float = 0.30) -> tuple[int, int]:
    """Frames that a signal must last, and that it may be gone."""
    return max(1, round(min_s / frame_s)), max(1, round(hang_s / frame_s))


def _rows(key: tuple, events: list[tuple], log: bool = False) -> pd.DataFrame:
    names = [c.split()[0] for c in (LOG if log else EVENTS).split(", ")]
    return pd.DataFrame([(*key, *e, "end")[: len(names)] if len(e) == 6 else (*key, *e) for e in events], columns=names)


def _fed(d: Detector, key: tuple, rows: pd.DataFrame, log: bool = False) -> pd.DataFrame:
    """What the frames end; with ``log`` what they begin as well, as rows without an end."""
    out: list[tuple] = []
    for start, power, overload in zip(rows["frame_start"], rows["power_db"], rows["overload"], strict=True):
        if power is None:
            out += d.leave(int(start))
            d.__init__(d.least, d.hang)
        else:
            out += d.frame(np.asarray(power, float), int(start), int(overload))
            out += [(c, began, None, None, flag, False, "open") for c, began, flag in d.opened if log]
    return _rows(key, out, log)


def standing(log: DataFrame) -> DataFrame:
    """The present events of a change log (LOG): each once, with a null end while it is on, or if the stream died before it ended."""
    ends = log.groupBy("receiver_id", "window_id", "channel", "start")
    return ends.agg(F.max("end").alias("end"), F.max("peak_snr").alias("peak_snr"), F.max("overload").alias("overload"), F.max("closed").alias("closed"))


def _flagged(frames: DataFrame) -> DataFrame:
    return frames if "overload" in frames.columns else frames.withColumn("overload", F.lit(0))


def detect(frames: DataFrame, frame_s: float, unclosed: bool = False, log: bool = False) -> DataFrame:
    """Events of a table of frames: the frames of a key pass in order through one task, batch by batch.

    ``unclosed`` adds those still on after the last frame of their receiver and window; ``log`` gives the
    change log (LOG) instead. Frames may carry an ``overload`` flag (0/1).
    """
    least, hang = settings(frame_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, d = None, None
        for batch in batches:
            for own, rows in batch.groupby(["receiver_id", "window_id"], sort=False):
                if own != key:
                    if unclosed and d is not None:
                        yield _rows(key, d.leave(), log)
                    key, d = own, Detector(least, hang)
                yield _fed(d, own, rows, log)
        if unclosed and d is not None:
            yield _rows(key, d.leave(), log)

    order = ["receiver_id", "window_id", "frame_no"]
    return _flagged(frames).repartition("receiver_id", "window_id").sortWithinPartitions(*order).select(*order, "frame_start", "power_db", "overload").mapInPandas(run, LOG if log else EVENTS)


class _Processor(StatefulProcessor):
    def __init__(self, least: int, hang: int, idle_ms: int | None, log: bool):
        self.made, self.idle_ms, self.log = (least, hang), idle_ms, log

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("detector", "blob binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else Detector(*self.made)
        frames = pd.concat(list(rows)).sort_values(["frame_start", "power_db"], key=lambda c: c if c.name == "frame_start" else c.notna())
        out = _fed(d, key, frames, self.log)
        self.state.update((pickle.dumps(d),))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            d = pickle.loads(bytes(self.state.get()[0]))
            self.state.clear()
            yield _rows(key, d.leave(), self.log)

    def close(self) -> None:
        pass


def detect_stream(frames: DataFrame, frame_s: float, idle_ms: int | None = None, log: bool = False) -> DataFrame:
    """The same over a stream; needs the RocksDB state store.

    A key's frames must come in order of batches, as :func:`receiver.in_order` hands them on. With
    ``log`` an event is reported when it begins and again when it ends, so one that a crash cut short
    is in the sink: :func:`standing` gives the present events. With ``idle_ms``, a key without frames for so long
    is let go and its open events are reported (``closed`` false), at the next trigger.
    ``query.stop()`` keeps the state in the checkpoint, so a restart goes on with the events that are open.
    """
    grouped = _flagged(frames).groupBy("receiver_id", "window_id")
    return grouped.transformWithStateInPandas(_Processor(*settings(frame_s), idle_ms, log), LOG if log else EVENTS, "Append", "None" if idle_ms is None else "ProcessingTime")


def statistics(progress: list[dict]) -> dict:
    """Frames, seconds, frames a second and milliseconds a frame of a query's progress reports (``query.recentProgress``)."""
    frames = sum(p["numInputRows"] for p in progress)
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in progress) / 1000
    return {"frames": frames, "seconds": seconds, "frames_per_s": frames / seconds if seconds else None, "ms_per_frame": 1000 * seconds / frames if frames else None}


def stalled(progress: list[dict], limit: int = 200) -> bool:
    """The last ``limit`` triggers all came without a row: the receiver has stopped sending."""
    return len(progress) >= limit and not any(p["numInputRows"] for p in progress[-limit:])


STORE = "spark.sql.streaming.stateStore.providerClass"
FILE_ROWS = 100_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started here keep their state in RocksDB, as those with several states must."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _filled(spark: SparkSession, path: str, files: int) -> None:
    """Adds files without rows to the folder ``in`` until it has so many."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    into, none = hadoop.Path(f"{path}/in"), hadoop.Path(f"{path}/none")
    fs = into.getFileSystem(conf)
    listed = lambda p: [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet")]
    short = files - len(listed(into))
    if short and not fs.exists(none):
        spark.read.parquet(f"{path}/in").limit(0).coalesce(1).write.parquet(f"{path}/none")
    for k in range(short):
        hadoop.FileUtil.copy(fs, listed(none)[0], fs, hadoop.Path(into, f"none-{files}-{k}.parquet"), False, conf)


def drained(frames: DataFrame, slices: list[DataFrame], job: Callable[[DataFrame], DataFrame], name: str, files: int = 1) -> DataFrame:
    """What ``job`` makes of a stream of ``slices``, each a micro-batch of at most ``files`` files, to their end.

    The source counts files, so a slice that has fewer is filled up with files without rows.
    """
    spark = frames.sparkSession
    path = scratch(spark, name)
    for k, part in enumerate(slices):
        if k and files > 1:
            _filled(spark, path, k * files)
        part.write.mode("append").parquet(f"{path}/in")
    with rocksdb(spark):
        files = 1_000_000 if len(slices) == 1 else files
        made = job(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in"))
        sink = made.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").option("path", f"{path}/out").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


def replayed(frames: DataFrame, frame_s: float) -> DataFrame:
    """Events that :func:`detect_stream` finds in a table of frames, streamed from its files to their end."""
    return drained(frames, [frames], lambda s: detect_stream(s, frame_s), "frames")


def shuffled(frames: DataFrame, job: Callable[[DataFrame], DataFrame], batches: int, lateness_s: float) -> DataFrame:
    """What ``job`` makes of a stream of a table of frames (``at`` among them) whose rows come up to half of ``lateness_s`` early or late.

    The table is cut into micro-batches by its times, each moved at random by a hash of the frame, and a micro-batch into
    files of about ``FILE_ROWS``, which tasks write side by side. After
    the last one a frame of no receiver, far enough ahead, lets the watermark pass all others.
    """
    lo, hi, n = frames.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at")), F.count(F.lit(1))).first()
    files = max(1, n // (batches * FILE_ROWS))
    half = int(lateness_s * 500_000)
    moved = F.unix_micros("at") + F.pmod(F.xxhash64("receiver_id", "frame_start", "frame_no"), F.lit(max(1, half)))
    step = max(1, -(-(hi + half - lo) // batches))
    slices = [frames.where(F.floor((moved - lo) / step) == k).coalesce(files) for k in range(batches)]
    last = frames.limit(1).withColumns({"receiver_id": F.lit(None).cast("string"), "at": F.timestamp_micros(F.lit(hi + 4 * half + 2_000_000))})
    return drained(frames, [*slices, last], job, "shuffled", files)
