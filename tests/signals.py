"""Signals with known properties, for tests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from bandloom.functions import dsp, golay


@dataclass(frozen=True)
class Transmission:
    channel: int
    start_s: float
    length_s: float
    snr_db: float = 34.0


SCENARIO = (Transmission(10, 2.0, 2.5), Transmission(16, 4.8, 0.8), Transmission(4, 5.9, 0.3), Transmission(24, 6.5, 1.6))
FRAMES = "receiver_id string, window_id long, frame_no long, frame_start long, power_db array<double>"


def frame_row(n: int, frame_s: float = 0.0131, rate: int = 2_400_000, channels: int = 40) -> tuple:
    """Noise about -90 dB, a transmission's level on its channel and skirts 8 dB down on its neighbours."""
    power = -90 + np.random.default_rng([1, n]).normal(0, 0.7, channels)
    t = n * frame_s
    for x in SCENARIO:
        if x.start_s <= t < x.start_s + x.length_s:
            for step, down in ((0, 0.0), (-1, 8.0), (1, 8.0)):
                power[x.channel + step] = max(power[x.channel + step], -90 + x.snr_db - down)
    return "uhf", 0, n, int(t * rate), power.tolist()


def samples(rate: float, length_s: float, deviation_hz: float, offset_hz: float = 12_500.0, tone_hz: float | None = None, dcs: str | None = None, noise: float = 0.05, seed: int = 1, inverted: bool = False) -> np.ndarray:
    """An FM signal of two voice tones with a sub-audible tone or code, in noise."""
    t = np.arange(int(rate * length_s)) / rate
    sub = 600.0 if tone_hz is not None or dcs is not None else 0.0
    inst = (deviation_hz - sub) / 2 * (np.sin(2 * np.pi * 700 * t) + np.sin(2 * np.pi * 1130 * t))
    if tone_hz is not None:
        inst += sub * np.sin(2 * np.pi * tone_hz * t)
    elif dcs is not None:
        bit = (t * dsp.BAUD).astype(int) % 23
        inst += sub * (2.0 * ((golay.plain_word(dcs) >> bit) & 1) - 1) * (-1 if inverted else 1)
    rng = np.random.default_rng(seed)
    return np.exp(2j * np.pi * (offset_hz * t + np.cumsum(inst) / rate)) + noise * (rng.normal(size=len(t)) + 1j * rng.normal(size=len(t)))
