"""Excerpts of events while the stream runs: samples from before the start on, taken once as soon as enough is written.

The detector runs on frames that carry samples. The last frames stay in the state as a ring; an event that
begins is pending, and each frame may settle it by the rule of ``operators.excerpts``: in full once so many samples
are there, with what it has where it ends before that, and not at all where that is too short to measure.
Samples that have left the ring, and those of a receiver that left its window, are null. The state of a key
is the ring (the longest excerpt, ``keep_s`` if that is more) and a few numbers for each event that is on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.excerpts import DWELL_S, HANG_S, LEAST_S, PRE_S
from .detector import Detector, settings

OUT = "receiver_id string, window_id long, channel int, start long, end long, first long, length long, i array<float>, q array<float>"
NAMES = [c.split()[0] for c in OUT.split(", ")]


class Pending:
    """Events of one key that wait for their samples: (channel, start) -> first sample wanted."""

    def __init__(self, frame_n: int, rate: float, dwell_s: float = DWELL_S, pre_s: float = PRE_S, least_s: float = LEAST_S, hang_s: float = HANG_S):
        self.frame_n = frame_n
        self.pre, self.full, self.least, self.hang = (round(s * rate) for s in (pre_s, dwell_s + pre_s, least_s, hang_s))
        self.first: dict[tuple[int, int], int] = {}

    def opened(self, channel: int, start: int) -> None:
        self.first[channel, start] = max(0, start - self.pre)

    def written(self, upto: int) -> list[tuple[int, int, None, int, int]]:
        """(channel, start, end, first, length) of those that have all they want."""
        due = [(c, s, None, first, self.full) for (c, s), first in self.first.items() if upto >= first + self.full]
        for c, s, *_ in due:
            del self.first[c, s]
        return due

    def ended(self, channel: int, start: int, end: int) -> list[tuple[int, int, int, int, int]]:
        first = self.first.pop((channel, start), None)
        if first is None:
            return []
        length = self.full if end + self.hang >= first + self.full else min(end - first, self.full)
        return [(channel, start, end, first, length)] if length >= self.least else []


class Ring:
    """Frames of samples by number, the oldest going when more than ``keep`` samples are there."""

    def __init__(self, frames: Iterator[tuple], frame_n: int, keep: int):
        self.frame_n, self.most = frame_n, -(-keep // frame_n) + 1
        self.frames = {no: (bytes(i), bytes(q)) for no, i, q in frames}

    def push(self, no: int, i: np.ndarray, q: np.ndarray) -> None:
        self.frames[no] = (i.astype("<f4").tobytes(), q.astype("<f4").tobytes())
        self.frames.pop(no - self.most, None)

    def get(self, first: int, length: int) -> tuple[list | None, list | None]:
        """The samples of that range, or nulls where one of its frames is missing."""
        wanted = [self.frames.get(no) for no in range(first // self.frame_n, (first + length - 1) // self.frame_n + 1)]
        if None in wanted:
            return None, None
        at = first % self.frame_n
        return tuple(np.frombuffer(b"".join(parts), "<f4")[at : at + length].tolist() for parts in zip(*wanted, strict=True))

    def rows(self) -> list[tuple]:
        """What stays: the last frames, gaps or not."""
        last = max(self.frames, default=0)
        return [(no, *iq) for no, iq in self.frames.items() if no > last - self.most]


class _Excerpter(StatefulProcessor):
    def __init__(self, made: tuple[int, int], frame_n: int, rate: float, keep_s: float, times: dict):
        self.made, self.frame_n, self.rate, self.keep_s, self.times = made, frame_n, rate, keep_s, times

    def init(self, handle) -> None:
        self.state = handle.getValueState("detector", "blob binary")
        self.frames = handle.getListState("ring", "no long, i binary, q binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d, pending = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else (Detector(*self.made), Pending(self.frame_n, self.rate, **self.times))
        ring = Ring(map(tuple, self.frames.get()) if self.frames.exists() else iter(()), self.frame_n, max(pending.full, round(self.keep_s * self.rate)) + self.made[1] * self.frame_n)
        out = []

        def take(due: list[tuple]) -> None:
            out.extend((*key, *e, *ring.get(e[3], e[4])) for e in due)

        frames = pd.concat(list(rows)).sort_values("frame_start")
        for start, power, overload, i, q in zip(frames["frame_start"], frames["power_db"], frames["overload"], frames["i"], frames["q"], strict=True):
            if power is None:  # the receiver leaves: what is on takes what there is
                for c, began, end, *_ in d.leave(int(start)):
                    take(pending.ended(c, began, end))
                d.__init__(*self.made)
                ring.frames.clear()
                continue
            ring.push(int(start) // self.frame_n, np.asarray(i), np.asarray(q))
            closed = d.frame(np.asarray(power, float), int(start), int(overload))
            for c, began, _ in d.opened:
                pending.opened(c, began)
            take(pending.written(int(start) + self.frame_n))
            for c, began, end, *_ in closed:
                take(pending.ended(c, began, end))
        self.state.update((pickle.dumps((d, pending)),))
        if kept := ring.rows():
            self.frames.put(kept)
        else:
            self.frames.clear()
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def excerpted(frames: DataFrame, frame_s: float, frame_n: int, keep_s: float = 0.0, **times: float) -> DataFrame:
    """A stream of frames (receiver_id, window_id, frame_start, power_db, overload, i, q; ``frame_n`` samples each) as excerpts (OUT).

    ``end`` is null where the event was still on. ``times``: dwell_s, pre_s, least_s, hang_s. A key's frames
    must come in order of batches; needs the RocksDB state store.
    """
    slim = frames.select("receiver_id", "window_id", "frame_start", "power_db", "overload", "i", "q").groupBy("receiver_id", "window_id")
    made = _Excerpter(settings(frame_s), frame_n, frame_n / frame_s, keep_s, times)
    return slim.transformWithStateInPandas(made, OUT, "Append", "None")
