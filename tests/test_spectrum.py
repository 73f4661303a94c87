"""Channel power, excerpts of events, the detector's flags and unclosed events, against plain arithmetic."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bandloom.functions import dsp, spectrum
from bandloom.operators import capture, excerpts
from bandloom.operators import signals as sigs
from bandloom.session import BATCH, BATCH_BYTES
from bandloom.sources import stations
from bandloom.streaming import detector

from . import signals


def test_frame_samples():
    assert spectrum.frame_samples(2_400_000) == 32_768 and spectrum.frame_samples(10_000_000) == 131_072 and spectrum.frame_samples(48_000) == 32_768


def test_periodogram_keeps_power_and_finds_the_tone():
    rate, x = 48_000.0, np.exp(2j * np.pi * 6_000 * np.arange(10_000) / 48_000.0)
    p = spectrum.periodogram(x, rate, 1024)
    assert abs(p.sum() * rate / 1024 - 1) < 0.01
    assert np.fft.fftshift(np.fft.fftfreq(1024, 1 / rate))[p.argmax()] == 6_000
    assert spectrum.periodogram(x[:1000], rate, 1024) is None


def test_channel_power_equals_a_loop_over_bins():
    center, rate = 466_000_000, 2.4e6
    density = np.random.default_rng(1).random(spectrum.NFFT) + 0.1
    numbers, first = spectrum.grid(center, rate)
    want: dict[int, list[float]] = {}
    for k in range(spectrum.GUARD, spectrum.NFFT - spectrum.GUARD):
        want.setdefault(round((center + (k - spectrum.NFFT // 2) * rate / spectrum.NFFT) / 6250), []).append(density[k])
    assert numbers.tolist() == list(want)
    assert np.allclose(spectrum.channel_db(density, first), [10 * np.log10(np.mean(v)) for v in want.values()])


def test_powers_of_frames(spark):
    rate, center, n = 2.4e6, 466_000_000, spectrum.frame_samples(2.4e6)
    x = [signals.samples(rate, n / rate, 2400.0, seed=k) for k in range(3)]
    rows = [("uhf", 0, center, k, k * n, x[k].real.tolist(), x[k].imag.tolist()) for k in range(3)]
    frames = spark.createDataFrame(rows, "receiver_id string, window_id long, center_hz long, frame_no long, frame_start long, i array<double>, q array<double>").repartition(2)
    short = frames.limit(1).withColumns({"frame_no": F.lit(99).cast("long"), "i": F.slice("i", 1, 100), "q": F.slice("q", 1, 100)})
    out = spectrum.powers(frames.unionByName(short), rate)
    assert sorted(r.frame_no for r in out.collect()) == [0, 1, 2]
    top = spectrum.by_channel(out).groupBy("frame_no").agg(F.max_by("freq_hz", "power_db").alias("f")).collect()
    assert {abs(r.f - center - 12_500) <= 6_250 for r in top} == {True}
    assert all(r.clip_frac > 0.5 and r.wideband_db < -60 for r in out.collect())


def test_excerpt_ranges(spark):
    rows = [(1, 1000, 3000, 9000), (2, 1000, 1500, 9000), (3, 1000, None, 1500), (4, 1000, None, 2000), (5, 100, 110, 9000), (6, 1000, 1650, 9000), (7, 0, 50, 50)]
    df = spark.createDataFrame(rows, "id long, start long, end long, written long")
    got = {r.id: (r.first, r.length) for r in excerpts.ranges(df, 1000.0).collect()}
    assert got == {1: (700, 1200), 2: (700, 800), 3: (700, None), 4: (700, 1200), 5: (0, None), 6: (700, 1200), 7: (0, None)}


def test_excerpts_are_fetched_whole_or_not_at_all(spark):
    n = 50
    frames = spark.createDataFrame([("uhf", 0, k, [float(k * n + j) for j in range(n)], [0.0] * n) for k in range(12) if k != 9], "receiver_id string, window_id long, frame_no long, i array<double>, q array<double>").repartition(4)
    wanted = spark.createDataFrame([(1, "uhf", 0, 30, 200), (2, "uhf", 0, 100, 50), (3, "uhf", 0, 420, 60), (4, "uhf", 0, 590, 100), (5, "uhf", 0, 0, None), (6, "vhf", 0, 0, 10)], "id long, receiver_id string, window_id long, first long, length long")
    got = {r.id: r.i for r in excerpts.fetched(wanted, frames, n).collect()}
    assert got[1] == [float(k) for k in range(30, 230)] and got[2] == [float(k) for k in range(100, 150)]
    assert got[3] is None and got[4] is None and got[5] is None and got[6] is None


def test_events_left_open_and_overload_of_the_opening_frame(spark):
    level = lambda k: -60.0 if 30 <= k < 60 or k >= 90 else -90.0
    rows = [("uhf", w, k, k * 1000, [-90.0, level(k), -90.0], int(k == 32)) for w in (0, 1) for k in range(120)]
    df = spark.createDataFrame(rows, "receiver_id string, window_id long, frame_no long, frame_start long, power_db array<double>, overload int").repartition(5)
    got = sorted((r.window_id, r.start, r.end, r.overload, r.closed) for r in detector.detect(df, 0.04, unclosed=True).collect())
    assert got == [(w, *e) for w in (0, 1) for e in ((30_000, 60_000, 1, True), (90_000, 119_000, 0, False))]
    assert detector.detect(df, 0.04).where("not closed").count() == 0


def test_replayed_stream_equals_batch(spark):
    rows = [(r, 0, k, k * 1000, [-90.0, -60.0 if 30 <= k < 60 else -90.0, -90.0], 0) for r in ("uhf", "vhf") for k in range(100)]
    df = spark.createDataFrame(rows, "receiver_id string, window_id long, frame_no long, frame_start long, power_db array<double>, overload int").repartition(3)
    got = sorted(map(tuple, detector.replayed(df, 0.04).collect()))
    assert got == sorted(map(tuple, detector.detect(df, 0.04).collect())) and len(got) == 2


def test_samples_come_in_small_batches(spark):
    """However many rows a task has, it holds a few MB of samples at a time."""
    rows = pd.DataFrame({"station": range(1000)})
    for samples, most in ((55_000, 9), (4096, 128), (10**8, 1)):
        parts = list(stations.sliced(iter([rows, rows[:3]]), samples))
        assert max(map(len, parts)) <= most and pd.concat(parts)["station"].tolist() == [*range(1000), 0, 1, 2]
    one = spark.range(1).selectExpr("id", "'uhf' AS receiver_id", "0L AS window_id", "466000000L AS center_hz", "id AS frame_no", "0L AS frame_start", "array(0F) AS i", "array(0F) AS q", "array(0D) AS audio_hz", "48000D AS rate", "0D AS offset")
    before = spark.conf.get(BATCH, None)
    try:
        for job in (lambda: spectrum.powers(one, 48_000.0), lambda: sigs.analysed(one, ["id"]), lambda: capture.recorded(one)):
            spark.conf.unset(BATCH)
            job()
            assert spark.conf.get(BATCH) == str(BATCH_BYTES)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def test_filters_are_products_of_matrices():
    """Every output is the filter's full sum, however its length and the step lie, at well under the time of a sum for each output."""
    rng = np.random.default_rng(1)
    for n, taps, by in ((1, 31, 7), (2000, 31, 1), (2001, 31, 7), (500, 31, 31), (2000, 31, 40), (10, 301, 2), (9000, 301, 2)):
        x, h = rng.normal(size=n) + 1j * rng.normal(size=n), rng.normal(size=taps) + 1j * rng.normal(size=taps)
        assert np.allclose(dsp.thinned(x, h, by), np.convolve(x, h)[::by]) and np.allclose(dsp.thinned(x.real, h.real, by), np.convolve(x.real, h.real)[::by])
    x, h = (rng.normal(size=55_000) + 1j * rng.normal(size=55_000)).astype(np.complex64), dsp.lowpass(301, 12_500.0, 50_000.0) + 0j
    windows = np.lib.stride_tricks.sliding_window_view(x, len(h))[::2]

    def least(f):
        took = []
        for _ in range(7):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        return min(took)

    assert 1.5 * least(lambda: dsp.thinned(x, h, 2)) < least(lambda: np.concatenate([windows[k : k + 4096] @ h for k in range(0, len(windows), 4096)]))


def test_tones_of_any_length_come_from_one_table():
    rate, hits = 2083.25, dsp.waves.cache_info().hits
    for n in (32, 2290, 2300, 4096, 9001):
        x = np.random.default_rng(n).normal(size=n)
        w = np.hanning(n)
        assert np.allclose(dsp.tone_strength(x, rate), np.abs((x * w) @ np.exp(-2j * np.pi * np.outer(np.arange(n) / rate, dsp.TONES))) / w.sum())
    assert dsp.waves.cache_info().hits == hits + 3


def test_samples_as_bytes_are_samples_as_arrays(spark, sf_dir):
    """What the query's signals say, with their samples handed on whole or number by number; each supplier's is there."""
    made = stations.signals(spark, sf_dir)
    rows = [(r.station, np.frombuffer(r.iq, np.complex64), r.rate, r.offset) for r in made.collect()]
    arrays = spark.createDataFrame([(s, x.real.tolist(), x.imag.tolist(), r, o) for s, x, r, o in rows], "station long, i array<float>, q array<float>, rate double, offset double")
    got, want = (sorted(map(tuple, sigs.analysed(df, ["station"]).collect())) for df in (made, arrays))
    assert got == want and len(got) == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
