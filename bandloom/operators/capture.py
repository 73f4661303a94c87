"""Recordings of events as bytes in rows: WAV audio and NPZ samples, under a budget."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..session import small_batches
from . import views

AUDIO_HZ, FULL_SCALE_HZ = 8_000, 5_000.0
FILES = "id long, audio binary, iq binary"
WAV_HEADER, NPZ_HEADER = 44, 600


def wav(audio_hz: np.ndarray, rate: float) -> bytes:
    """Frequency deviation as 16-bit mono at 8 kHz; 5 kHz is full scale."""
    by = max(1, round(rate / AUDIO_HZ))
    thin = dsp.thinned(np.asarray(audio_hz, float), dsp.lowpass(101, AUDIO_HZ * 0.45, rate), by)
    pcm = np.clip(thin / FULL_SCALE_HZ, -1, 1) * 32767
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(AUDIO_HZ)
        w.writeframes(pcm.astype("<i2").tobytes())
    return out.getvalue()


def npz(baseband: np.ndarray, rate: float) -> bytes:
    out = io.BytesIO()
    np.savez(out, baseband=baseband.astype(np.complex64), fs=rate)
    return out.getvalue()


def recorded(events: DataFrame) -> DataFrame:
    """(id, audio, iq) files of (id, audio_hz, i, q, rate)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "audio": [wav(a, r) for a, r in zip(b["audio_hz"], b["rate"], strict=True)], "iq": [npz(np.asarray(i) + 1j * np.asarray(q), r) for i, q, r in zip(b["i"], b["q"], b["rate"], strict=True)]})

    small_batches(events.sparkSession)
    return events.select("id", "audio_hz", "i", "q", "rate").mapInPandas(run, FILES)


LEAST_FREE = 500_000_000


def within_budget(events: DataFrame, budget: int, free: int | None = None) -> DataFrame:
    """Events in order of id whose files, headers included, still fit; checked before anything is written.

    ``free``: bytes free on the disk, of which LEAST_FREE must stay.
    """
    budget = budget if free is None else min(budget, free - LEAST_FREE)
    seconds = F.size("i") / F.col("rate")
    size = (seconds * AUDIO_HZ * 2 + WAV_HEADER + F.size("i") * 8 + NPZ_HEADER).cast("long")
    return views.running_budget(events.withColumn("bytes", size), "id", "bytes", budget)
