"""From samples to channel power: mean periodograms and the absolute channel grid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

#: Channel spacing, transform length, bins left out at either edge, clipping level.
CHANNEL_HZ, NFFT, GUARD, CLIP = 6_250.0, 4_096, 8, 0.9


def frame_samples(rate: float, seconds: float = 0.013) -> int:
    """Samples of a frame of about ``seconds``: a power of two, 2^15 at least."""
    return 2 ** max(15, round(math.log2(rate * seconds)))


def periodogram(x: np.ndarray, rate: float, nfft: int = NFFT) -> np.ndarray | None:
    """Power density over all whole segments, lowest frequency first; None if there is no whole one."""
    n = len(x) // nfft
    if not n:
        return None
    w = np.hanning(nfft)
    spectra = np.fft.fft(np.reshape(x[: n * nfft], (n, nfft)) * w)
    return np.fft.fftshift((spectra.real**2 + spectra.imag**2).mean(axis=0)) / (rate * (w @ w))


def grid(center_hz: float, rate: float, nfft: int = NFFT, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """Channel numbers (frequency over spacing), rising, and the first bin of each; bins run from ``guard`` to ``nfft - guard``."""
    bins = np.arange(guard - nfft // 2, nfft // 2 - guard) * (rate / nfft)
    numbers = np.rint((center_hz + bins) / CHANNEL_HZ).astype(np.int64)
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[first], first


def channel_db(density: np.ndarray, first: np.ndarray, guard: int = GUARD) -> np.ndarray:
    """Mean density of each channel's bins, in dB."""
    used = density[guard : len(density) - guard]
    count = np.diff(first, append=len(used))
    return 10 * np.log10(np.add.reduceat(used, first) / count + 1e-20)


POWER = "receiver_id string, window_id long, frame_no long, frame_start long, first_channel long, power_db array<double>, wideband_db double, clip_frac double"


def powers(samples: DataFrame, rate: float, nfft: int = NFFT) -> DataFrame:
    """Frames of samples (receiver_id, window_id, center_hz, frame_no, frame_start, i, q) as frames of channel power.

    A row for each frame with a whole segment: the power of consecutive channels from
    ``first_channel`` on, their median, and the share of samples beyond the clipping level.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x = np.asarray(r.i) + 1j * np.asarray(r.q)
                density = periodogram(x, rate, nfft)
                if density is not None:
                    channels, first = grid(r.center_hz, rate, nfft)
                    db = channel_db(density, first)
                    out.append((r.receiver_id, r.window_id, r.frame_no, r.frame_start, channels[0], db, float(np.median(db)), float((np.abs(x) > CLIP).mean())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in POWER.split(", ")])

    small_batches(samples.sparkSession)
    return samples.select("receiver_id", "window_id", "center_hz", "frame_no", "frame_start", "i", "q").mapInPandas(run, POWER)


def by_channel(frames: DataFrame) -> DataFrame:
    """A row for each frame and channel, with the channel's frequency."""
    each = frames.select("receiver_id", "window_id", "frame_no", "first_channel", F.posexplode("power_db").alias("_k", "power_db"))
    return each.select("receiver_id", "window_id", "frame_no", ((F.col("first_channel") + F.col("_k")) * CHANNEL_HZ).cast("long").alias("freq_hz"), "power_db")
