"""What comes before the detector in a stream: a receiver's frames in order, flagged, with the windows it leaves.

Frames may come late and out of order. They wait in the state by their place in the receiver's sample
clock until the watermark has passed them, and are then handed on in order; those older than the watermark are
dropped by Spark and counted (:func:`losses`). On the way each frame is compared with the receiver's
last levels: a level well above the 20th percentile of these, or clipped samples, is an overload. The levels
are kept when the receiver turns to another window; the window it leaves gets a frame without power, which
tells the detector to end what is on there.

The state of a receiver is the frames of the last ``lateness`` and 300 levels. Receivers are dealt to buckets, which are
the keys, so that what a key costs in each batch (state calls, timers, small tables) doesn't grow with the receivers.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.detect import percentile_of
from ..session import BATCH_BYTES

HISTORY, WARM, DESENSE_DB, CLIPPED = 300, 60, 6.0, 1e-4
BUCKETS, ROWS, MONITORS = 256, 10_000, 1_000
WAITING = pa.schema([
    ("receiver_id", pa.string()), ("frame_start", pa.int64()), ("frame_no", pa.int64()), ("window_id", pa.int64()), ("at", pa.int64()),
    ("wideband_db", pa.float64()), ("clip_frac", pa.float64()), ("power_db", pa.list_(pa.float64())),
])
READY = "receiver_id string, window_id long, frame_no long, frame_start long, at timestamp, power_db array<double>, baseline double, overload int"
NAMES = [c.split()[0] for c in READY.split(", ")]


class Monitor:
    """The last levels of a receiver, in order of time and of size, and the window it is in."""

    def __init__(self, window: int | None = None, past: bytes = b""):
        self.window = window
        self.past: list[float] = np.frombuffer(past).tolist()
        self.sorted = sorted(self.past)

    def packed(self) -> tuple[int | None, bytes]:
        return self.window, np.array(self.past, float).tobytes()

    def flag(self, level: float | None, clip: float | None) -> tuple[float | None, int]:
        """(baseline, overload 0/1) of the next frame; a frame without level leaves the others where they are."""
        if level is not None:
            if len(self.past) == HISTORY:
                del self.sorted[bisect_left(self.sorted, self.past.pop(0))]
            self.past.append(level)
            insort(self.sorted, level)
        base = percentile_of(self.sorted, 0.2) if len(self.sorted) >= WARM else None
        high = base is not None and level is not None and level - base > DESENSE_DB
        return base, int(high or (clip is not None and clip > CLIPPED))


def _known(x: float | None) -> float | None:
    return None if x is None or x != x else float(x)


def _kept(state, parts: Iterable[bytes]) -> None:
    """A list of bytes as the state's value, a few MB at a time."""
    state.clear()
    for part in parts:
        state.appendValue((part,))


def _read(state) -> list[bytes]:
    return [bytes(part) for (part,) in state.get()] if state.exists() else []


def _packed(frames: pd.DataFrame) -> Iterator[bytes]:
    """Frames in Arrow's stream format, a few MB a part."""
    table = pa.Table.from_pandas(frames, WAITING, preserve_index=False)
    step = max(1, BATCH_BYTES * len(table) // max(1, table.nbytes))
    for k in range(0, len(table), step):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, WAITING) as writer:
            writer.write_table(table.slice(k, step))
        yield out.getvalue().to_pybytes()


class _Receivers(StatefulProcessor):
    """The receivers of a bucket."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "part binary")
        self.monitors = handle.getListState("monitors", "part binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [batch.assign(at=batch["at"].astype("datetime64[us]").astype("int64"))[WAITING.names] for batch in rows]
        yield from self._released(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._released([], timerValues)

    def _released(self, new: list[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Frames that the watermark has passed, each once. The next one waiting sets the timer, so none stays longer than it must."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        before = [pa.ipc.open_stream(part).read_pandas() for part in _read(self.waiting)]
        if not before and not new:
            return
        every = pd.concat([*before, *new], ignore_index=True)
        if not new and every["at"].min() > passed:
            return  # their timer is set
        every["receiver_id"] = every["receiver_id"].astype(object).where(every["receiver_id"].notna(), None)  # a missing name is one, NaN would be many
        every = every.drop_duplicates(["receiver_id", "frame_start", "frame_no"], keep="last")
        due = every["at"] <= passed
        later = every[~due]
        if len(later):
            self.handle.registerTimer(-(-int(later["at"].min()) // 1000))
        _kept(self.waiting, _packed(later))
        if due.any():
            yield from self._flagged(every[due])

    def _flagged(self, due: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Each receiver's frames in order of the sample clock, with their flags and the windows that it leaves."""
        monitors = {name: packed for part in _read(self.monitors) for name, packed in pickle.loads(part)}
        codes, _ = pd.factorize(due["receiver_id"], use_na_sentinel=False)
        due = due.iloc[np.lexsort((due["frame_no"], due["frame_start"], codes))]
        own, monitor, out = (), None, []
        columns = (due[c].tolist() for c in ("receiver_id", "window_id", "frame_no", "frame_start", "at", "wideband_db", "clip_frac"))
        for name, window, no, start, us, level, clip, power in zip(*columns, due["power_db"], strict=True):
            if own != (name,):
                if monitor is not None:
                    monitors[own[0]] = monitor.packed()
                own, monitor = (name,), Monitor(*monitors.get(name, ()))
            if monitor.window is not None and window != monitor.window:
                out.append((name, monitor.window, no, start, us, None, None, 0))
            monitor.window = window
            out.append((name, window, no, start, us, power, *monitor.flag(_known(level), _known(clip))))
            if len(out) >= ROWS:
                yield _ready(out)
                out = []
        monitors[own[0]] = monitor.packed()
        every = list(monitors.items())
        _kept(self.monitors, (pickle.dumps(every[k : k + MONITORS]) for k in range(0, len(every), MONITORS)))
        if out:
            yield _ready(out)

    def close(self) -> None:
        pass


def _ready(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=NAMES)
    made["at"] = pd.to_datetime(made["at"].astype("int64"), unit="us").dt.as_unit("us")
    return made


def in_order(frames: DataFrame, lateness: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of frames (receiver_id, window_id, frame_no, frame_start, at, power_db, wideband_db, clip_frac) as READY has them.

    ``at`` is the time of the frame's first sample by the sample clock. A task holds what a micro-batch and the state have of a
    bucket, a receiver at least; ``buckets`` stays as it is while a checkpoint lives. Needs the RocksDB state store.
    """
    slim = frames.select("receiver_id", "window_id", "frame_no", "frame_start", "at", "power_db", "wideband_db", "clip_frac").withWatermark("at", lateness)
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64("receiver_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Receivers(), READY, "Append", "EventTime", eventTimeColumnName="at")


def counted(frames: DataFrame, name: str = "received") -> DataFrame:
    """``frames`` with their number, and the sum of ``overflows`` if they have it, in the query's progress under ``name``."""
    more = [F.sum("overflows").alias("overflows")] if "overflows" in frames.columns else []
    return frames.observe(name, F.count(F.lit(1)).alias("frames"), *more)


def losses(progress: list[dict], name: str = "received") -> dict[str, int]:
    """Frames received, samples lost before they came (overflows), and frames dropped as later than the watermark."""
    seen = [p.get("observedMetrics", {}).get(name) for p in progress]
    of = lambda m, c: (m.asDict() if hasattr(m, "asDict") else dict(m)).get(c) or 0
    late = sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p.get("stateOperators", []))
    return {"frames": sum(of(m, "frames") for m in seen if m), "overflows": sum(of(m, "overflows") for m in seen if m), "late": late}
