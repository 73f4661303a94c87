"""Small hand-made tables with known answers: enrichment, tiers, detection, mutations, codes, signals."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom import schemas
from bandloom.functions import dsp, golay
from bandloom.operators import bandplan, detect, enrich, mutations, views
from bandloom.operators import signals as sigs
from bandloom.streaming import detector

from . import signals

PLAN = "id long, freq_lo_hz long, freq_hi_hz long, freq_center_hz long, bandwidth_hz long, service string, label string, kind string, is_repeater_out int, pair_offset_hz long, licensed int"
ROWS = [
    (1, 462_668_750, 462_681_249, 462_675_000, 20_000, "gmrs", "GMRS 20", "channel", 1, 5_000_000, 1), (2, 467_668_750, 467_681_249, 467_675_000, 20_000, "gmrs", "GMRS 20 in", "channel", 0, None, 1),
    (3, 144_000_000, 148_000_000, None, None, "ham2m", "2 m", "segment", 0, None, 1), (4, 462_668_750, 462_681_249, 462_675_000, 12_500, "frs", "FRS X", "channel", 0, None, 0),
]
EVENTS = "id long, t_us long, freq_hz long, duration_s double, snr_db double, deviation_hz double, tone_state string, ctcss_hz double, dcs_code int, dcs_polarity string, modulation string"


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame(ROWS, PLAN)


def events(spark, *groups):
    rows, n = [], 0
    for how in groups:
        for k in range(how.pop("n", 1)):
            n += 1
            base = {"id": n, "t_us": n * 10_000_000, "freq_hz": 462_675_000, "duration_s": 2.0, "snr_db": 30.0, "deviation_hz": None, "tone_state": "unknown", "ctcss_hz": None, "dcs_code": None, "dcs_polarity": None, "modulation": "nfm"}
            rows.append(tuple((base | {a: b(k) if callable(b) else b for a, b in how.items()}).values()))
    return spark.createDataFrame(rows, EVENTS)


def one(spark, plan, *groups):
    return enrich.rollup(events(spark, *groups), plan).collect()


def test_lookup_orders_and_ties(spark, plan):
    f = spark.createDataFrame([(462_675_400,), (146_520_000,), (100,)], "freq_hz long")
    assert [(r.id, r.place) for r in bandplan.lookup(f, plan).where("freq_hz > 4e8").orderBy("place").collect()] == [(4, 1), (1, 2)]
    assert {r.freq_hz: len(r.tied) for r in bandplan.tied(f, plan).collect()} == {462_675_400: 2, 146_520_000: 1}
    assert [r.freq_hz for r in bandplan.unallocated(f, plan).collect()] == [100]
    assert {r.freq_hz: r.key for r in bandplan.channel_key(f, plan).collect()} == {462_675_400: 462_675_000, 146_520_000: 146_518_750, 100: 0}
    assert {r.freq_hz: r.text for r in bandplan.described(f, plan).collect()}[462_675_400] == "FRS X (+0.40 kHz) in GMRS 20"


def test_in_flight_rows_count_but_add_no_time(spark, plan):
    (r,) = one(spark, plan, {"n": 3}, {"duration_s": None})
    assert (r.event_count, r.total_airtime_s, r.freq_hz) == (4, 6.0, 462_675_000)
    (r,) = one(spark, plan, {"n": 3, "duration_s": None})
    assert (r.event_count, r.total_airtime_s) == (3, 0.0)


def test_segment_channels_report_the_median(spark, plan):
    (r,) = one(spark, plan, {"n": 5, "freq_hz": lambda k: 146_820_000 + (k - 2) * 100})
    assert r.freq_hz == 146_820_000 and r.label == "2 m"
    assert len(one(spark, plan, {"freq_hz": 146_470_000}, {"freq_hz": 146_600_000})) == 2


@pytest.mark.parametrize(("groups", "state", "ctcss", "dcs"), [
    ([{"n": 6, "tone_state": "ctcss", "ctcss_hz": 141.3}], "ctcss", 141.3, None),
    ([{"n": 6, "tone_state": "ctcss", "ctcss_hz": lambda k: [67.0, 100.0, 141.3][k % 3]}], "unknown", None, None),
    ([{"n": 6, "tone_state": "dcs"}], "dcs", None, None),
    ([{"n": 6, "tone_state": "dcs", "dcs_code": 23, "dcs_polarity": "N"}], "dcs", None, 23),
    ([{"n": 6, "tone_state": "dcs", "dcs_code": lambda k: [23, 31, 43][k % 3]}], "unknown", None, None),
    ([{"n": 4, "tone_state": "ctcss", "ctcss_hz": 88.5}, {"n": 8}], "ctcss", 88.5, None),
    ([{"n": 4, "tone_state": "ctcss", "ctcss_hz": 88.5}, {"tone_state": "none"}], "ctcss", 88.5, None),  # 0.8 passes
])
def test_tone_decisions(spark, plan, groups, state, ctcss, dcs):
    (r,) = one(spark, plan, *[dict(g) for g in groups])
    assert (r.tone_state, r.ctcss_hz, r.dcs_code) == (state, ctcss, dcs)


@pytest.mark.parametrize(("groups", "label"), [
    ([{"n": 6, "deviation_hz": 2400.0}], "FRS X / GMRS 20"), ([{"n": 6, "deviation_hz": 4900.0}], "GMRS 20"), ([{"n": 6, "deviation_hz": 4000.0}], "FRS X / GMRS 20"),
    ([{"n": 6, "deviation_hz": 4001.0}], "GMRS 20"), ([{"n": 8, "deviation_hz": 5400.0, "snr_db": 17.0}], "FRS X / GMRS 20"), ([{"n": 2, "deviation_hz": 5400.0}], "FRS X / GMRS 20"),
    ([{"n": 8, "deviation_hz": 5400.0, "snr_db": 10.0}, {"n": 4, "deviation_hz": 2400.0}], "FRS X / GMRS 20"),
])
def test_deviation_narrows_shared_channels(spark, plan, groups, label):
    assert one(spark, plan, *[dict(g) for g in groups])[0].label == label


def test_pairs_need_enough_close_keyups(spark):
    pairs = spark.createDataFrame([(2, 1, 1)], "output_hz long, input_hz long, offset_hz long")

    def found(lag_us, n):
        rows = [(2 * k + c, k * 60_000_000 + (0 if c else lag_us), 1 if c else 2) for k in range(n) for c in (0, 1)]
        return enrich.pair_evidence(spark.createDataFrame(rows, "id long, t_us long, channel_hz long"), pairs).collect()

    (r,) = found(60_000, 8)
    assert (r.evidence_count, r.median_lag_us, r.confidence) == (8, 60_000.0, 1.0)
    assert len(found(1_000_000, 8)) == 1 and found(1_000_001, 8) == [] and found(60_000, 2) == []


def test_tier_ladder(spark):
    rows = [
        (None, "none", None, None, 0, False, "frs", 0, 0), (2400.0, "unknown", None, None, 0, False, "frs", 0, 1), (2400.0, "dcs", None, None, 0, False, "frs", 0, 2),
        (2400.0, "none", None, None, 1, False, "gmrs", 1, 2), (2400.0, "none", None, None, 1, True, "gmrs", 1, 4), (2400.0, "ctcss", 88.5, None, 0, False, "ham", 1, 3),
        (2400.0, "ctcss", 88.5, None, 0, False, "frs", 0, 4), (2400.0, "dcs", None, 23, None, False, None, None, 3),
    ]
    df = spark.createDataFrame(rows, "deviation_hz double, tone_state string, ctcss_hz double, dcs_code int, is_repeater_out int, paired boolean, service string, licensed int, want int")
    out = enrich.tiers(df, ("gmrs",)).collect()
    assert [r.tier for r in out] == [r.want for r in out]
    assert [r.n for r in enrich.tier_histogram(enrich.tiers(df, ("gmrs",))).orderBy("tier").collect()] == [1, 1, 2, 2, 2]


def frames(spark, levels, step=1000):
    return spark.createDataFrame([(1, k, k * step, float(v)) for k, v in enumerate(levels)], "ch int, no int, start long, snr double")


def track(df):
    return [(r.start, r.end, r.peak) for r in detect.tracked(df, "ch", ["no"], "snr", "start", 10, 6, 3, 8).orderBy("event_no").collect()]


def test_tracker_edges_and_hysteresis(spark):
    quiet, loud = [0] * 10, [20] * 20
    assert track(frames(spark, quiet + loud + [0] * 30)) == [(10_000, 30_000, 20.0)]
    assert track(frames(spark, quiet + loud + [8] * 20 + [0] * 20)) == [(10_000, 50_000, 20.0)]  # 8 dB holds
    assert track(frames(spark, [8] * 40)) == [] and track(frames(spark, quiet + [20] * 2 + [0] * 20)) == []
    assert track(frames(spark, quiet + loud)) == [(10_000, None, 20.0)]


def test_detector_finds_the_scenario_and_streams_alike(spark, tmp_path):
    rows = [signals.frame_row(n) for n in range(700)]
    for part in (rows[:350], rows[350:]):
        spark.createDataFrame(part, signals.FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    key = lambda df: sorted((r.channel, r.start, r.end, round(r.peak_snr, 6)) for r in df.collect())
    got = key(detector.detect(batch, 0.0131))
    assert [c for c, *_ in got] == [4, 10, 16, 24]
    for c, start, end, peak in got:
        x = next(t for t in signals.SCENARIO if t.channel == c)
        assert abs(start / 2.4e6 - x.start_s) < 0.03 and abs((end - start) / 2.4e6 - x.length_s) < 0.05 and peak > 25
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(signals.FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = detector.detect_stream(stream, 0.0131).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/log").start()
    try:
        for _ in range(60):
            q.awaitTermination(2)
            if len(rows := key(spark.table("found"))) >= len(got):
                break
        said = detector.statistics(q.recentProgress)
        assert said["frames"] == 700 and said["frames_per_s"] > 0 and not detector.stalled(q.recentProgress)
    finally:
        q.stop()
    assert rows == got


def test_receiver_that_leaves_its_window(spark, tmp_path):
    level = lambda k: -60.0 if k >= 90 else -90.0
    rows = [("uhf", 0, k, k * 1000, [-90.0, level(k), -90.0]) for k in range(120)] + [("uhf", 0, 120, 120_000, None)]
    rows += [("uhf", 0, k, k * 1000, [-90.0, -60.0 if 200 <= k < 220 else -90.0, -90.0]) for k in range(121, 270)]
    df = spark.createDataFrame(rows, signals.FRAMES).repartition(3)
    want = [(90_000, 120_000, False), (200_000, 220_000, True)]
    assert sorted((r.start, r.end, r.closed) for r in detector.detect(df, 0.04).collect()) == want
    df.where("frame_no <= 110").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(signals.FRAMES).parquet(f"{tmp_path}/in")
    q = detector.detect_stream(stream, 0.04, idle_ms=3000).writeStream.format("memory").queryName("left").outputMode("append").option("checkpointLocation", f"{tmp_path}/log").start()
    try:
        for _ in range(40):
            q.awaitTermination(2)
            if spark.table("left").count():
                break
        assert [(r.start, r.end, r.closed) for r in spark.table("left").collect()] == [(90_000, 110_000, False)]
    finally:
        q.stop()
    assert detector.stalled([{"numInputRows": 0}] * 200) and not detector.stalled([{"numInputRows": 0}] * 199)


def test_floor_freezes_while_active():
    d = detector.Detector(3, 8)
    for k in range(200):
        d.frame(np.array([-60.0 if 30 <= k else -90.0, -90.0, -90.0, -90.0]), k)
    assert d.active[0] and abs(d.floor[0] + 90) < 0.5


def test_golay_corrects_three_errors_and_knows_its_codes(spark):
    ref = 0b100_000010011_11101100011
    got = spark.range(1).select(golay.squelch_word(F.lit("023")).alias("w")).first().w
    assert got == ref and len(golay.CODES) == 112
    words = spark.createDataFrame([(c,) for c in golay.CODES], "code string").withColumn("word", golay.squelch_word(F.col("code"))).withColumnRenamed("code", "sent")
    for flips in (0, 1 << 5, 1 << 5 | 1 << 22, 1 | 1 << 9 | 1 << 17):
        out = golay.decoded(words.withColumn("word", F.col("word").bitwiseXOR(flips))).collect()
        assert len(out) == 112 and all(r.code == r.sent and r.errors == flips.bit_count() for r in out)
    assert golay.inverse_pairs(spark).count() >= 60


def analysed(spark, cases):
    """Results of (samples, rate) by their place in the list."""
    rows = [(k, x.real.astype(np.float32).tolist(), x.imag.astype(np.float32).tolist(), rate, offset) for k, (x, rate, offset) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, i array<float>, q array<float>, rate double, offset double").repartition(8)
    got = {r.id: r for r in sigs.analysed(df, ["id"]).withColumn("tone_state", sigs.tone_state()).collect()}
    return [got[k] for k in range(len(cases))]


def test_signals(spark):
    def made(rate, *how, offset=12_500.0, **more):
        return signals.samples(rate, *how, **more), rate, offset

    devs, tones, codes, fast = (1500.0, 3000.0, 5000.0), (67.0, 141.3, 254.1), ("023", "155", "754"), 250_000.0
    got = analysed(spark, [*(made(fast, 1.0, d) for d in devs), *(made(fast, 1.1, 4000.0, tone_hz=t) for t in tones), *(made(fast, 1.1, 4000.0, dcs=c) for c in codes), (np.zeros(100, complex), fast, 0.0), made(fast, 0.71, 4000.0, tone_hz=141.3), made(fast, 0.3, 2400.0)])
    for dev, r in zip(devs, got, strict=False):
        assert abs(r.deviation_hz / dev - 1) < 0.15 and abs(r.freq_error_hz) < 60 and r.tone_checked and r.ctcss_hz is None and r.tone_state == "none"
    assert [r.ctcss_hz for r in got[3:6]] == list(tones) and {r.tone_state for r in got[3:6]} == {"ctcss"}
    for code, r in zip(codes, got[6:9], strict=True):
        assert r.dcs_suspected and r.dcs_code == int(code) and r.dcs_polarity == "N" and 0 < r.ctcss_conf < 0.3 and r.tone_state == "dcs"
    short, brief, least = got[9:]
    assert short.deviation_hz is None and short.tone_checked is None and short.tone_state == "unknown"
    assert not brief.tone_checked and brief.deviation_hz > 3000 and brief.tone_state == "unknown"  # what is left of the filter is shorter than the gate
    assert not least.tone_checked and least.ctcss_conf == 0.0


def test_a_wide_receiver_is_thinned_and_moved_to_the_channel(spark):
    """Every output is the filter's full sum, and the channel is moved to zero, at 10 MSPS as well."""
    rng = np.random.default_rng(1)
    x, taps = rng.normal(size=5000) + 1j * rng.normal(size=5000), rng.normal(size=31)
    assert np.allclose(dsp.thinned(x, taps, 7), np.convolve(x, taps)[::7])
    t = np.arange(1_000_000) / 1e7
    base, fs = dsp.channel(np.exp(2j * np.pi * 1_262_700.0 * t), 1e7, 1_262_500.0)
    assert abs(dsp.frequency(base, fs)[50:-50].mean() - 200) < 1 and abs(fs - 24_000) < 50


def test_every_code_in_both_polarities(spark):
    partners = {r.code: r.reads_as for r in golay.inverse_pairs(spark).collect()}
    assert partners["023"] == "047" and set(partners) == set(partners.values()) == set(golay.CODES)
    every = analysed(spark, [(signals.samples(50_000.0, 1.0, 3000.0, dcs=c, inverted=turned), 50_000.0, 12_500.0) for turned in (False, True) for c in golay.CODES])
    assert [r.dcs_code for r in every] == [int(c) for c in golay.CODES] + [int(partners[c]) for c in golay.CODES]


def test_codes_need_repeats_that_agree_and_their_partner(spark):
    rate, n = 2000.0, 2000
    words, full = {c: golay.plain_word(c) for c in golay.CODES}, (1 << 23) - 1

    def sent(words):
        at = (np.arange(n) / rate * dsp.BAUD).astype(int)
        return np.array([2.0 * (words[b // 23 % len(words)] >> b % 23 & 1) - 1 for b in at])

    noise = [np.convolve(np.random.default_rng(k).normal(size=n + 254), dsp.lowpass(255, 300.0, rate), "valid") for k in range(300)]
    cases = [sent([words[c] ^ flip]) for c in golay.CODES for flip in (0, 0x100208, full)]
    cases += [sent([words[c] for c in ("023", "155", "754", "306", "632")]), sent([words["023"]])[:500], *noise]
    rows = [(k, dsp.code_words(x, rate)) for k, x in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, words array<int>").where("words IS NOT NULL").repartition(8)
    got = {r.id: (r.code, r.polarity, r.errors, r.agree) for r in sigs.codes(df, ["id"]).collect()}
    partners = {r.code: r.reads_as for r in golay.inverse_pairs(spark).collect()}
    for k, c in enumerate(golay.CODES):
        assert got[3 * k] == (c, "N", 0, 5) and got[3 * k + 1][:3] == (c, "N", 3) and got[3 * k + 2][:3] == (partners[c], "N", 0)
    assert set(got) == set(range(3 * len(golay.CODES))) and rows[3 * len(golay.CODES) + 1][1] is None


def test_mutations_and_schema(spark, tmp_path):
    path = f"file://{tmp_path}/channels"
    mutations.swapped(spark.range(3), path)
    mutations.swapped(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="unknown columns"):
        mutations.appended([{"nope": 1}], "events", spark, path)
    with pytest.raises(ValueError, match="tone_state"):
        mutations.appended([{"tone_state": "loud"}], "events", spark, path)
    mutations.appended([{"id": 1, "run_id": 1, "receiver_id": "uhf", "t_start": 0.0, "freq_hz": 1, "overload": 0, "tone_state": "none"}], "events", spark, f"{path}-e")
    assert spark.read.parquet(f"{path}-e").first().tone_state == "none"
    some = spark.range(3).selectExpr("id", "1L AS run_id", "'uhf' AS receiver_id", "0.0D AS t_start", "1L AS freq_hz", "0 AS overload", "if(id = 2, 'dcs', null) AS tone_state")
    mutations.appended(some, "events", spark, f"{path}-e")
    assert spark.read.parquet(f"{path}-e").count() == 4
    for wrong, said in ((some.withColumn("nope", F.lit(1)), "unknown columns"), (some.withColumn("tone_state", F.lit("loud")), "tone_state")):
        with pytest.raises(ValueError, match=said):
            mutations.appended(wrong, "events", spark, f"{path}-e")
    old = spark.createDataFrame([(1, 88.5, None), (2, None, 23), (3, None, None)], "id long, ctcss_hz double, dcs_code int")
    new = schemas.migrated(old, "events", 2)
    assert [r.tone_state for r in new.orderBy("id").collect()] == ["ctcss", "dcs", "unknown"] and "window_id" in new.columns
    assert schemas.migrated(new, "events", 8).columns == new.columns
    with pytest.raises(ValueError, match="older"):
        schemas.migrated(new, "events", 8, 7)
    bad = spark.createDataFrame([(5.0, 4.0, -1.0, 88.5, 23, "X", "loud", 2.0, 3)], "t_start double, t_end double, duration_s double, ctcss_hz double, dcs_code int, dcs_polarity string, tone_state string, confidence double, overload int")
    assert {r.rule for r in schemas.violations(bad, schemas.checks("events")).where("n = 1").collect()} == set(schemas.checks("events"))


def test_running_budget(spark):
    df = spark.range(250_000).withColumn("size", F.lit(2))
    assert views.running_budget(df, "id", "size", 300_001).count() == 150_000
    sparse = spark.range(3000).selectExpr("id * 1000003 AS id", "id % 7 AS size")
    used = 0
    for k in range(3000):
        used += k % 7
        if used > 5000:
            break
    assert views.running_budget(sparse, "id", "size", 5000).count() == k
    assert views.running_budget(sparse.limit(0), "id", "size", 10).count() == 0


def test_agreement_is_not_rounded(spark):
    rows = [(0, "none", 4), (0, "ctcss", 1), (1, "none", 17), (1, "ctcss", 3), (2, "none", 83), (2, "ctcss", 17), (3, "none", 86), (3, "ctcss", 14)]
    e = spark.createDataFrame(rows, "key int, state string, n int").selectExpr("key", "state", "explode(sequence(1, n))", "if(state = 'ctcss', 88.5D, null) AS ctcss_hz", "cast(null AS int) AS dcs_code", "cast(null AS string) AS dcs_polarity")
    v = enrich.votes(e, "key", ["state", "ctcss_hz", "dcs_code", "dcs_polarity"])
    of = lambda a: {r.key: r.tone_state for r in enrich.tone_decision(v, "key", a).collect()}
    assert of(0.8) == dict.fromkeys(range(4), "none")
    assert of(0.85) == {0: "unknown", 1: "none", 2: "unknown", 3: "none"}


def test_windows_of_any_length_count_their_events(spark):
    rng = np.random.default_rng(2)
    events = [(int(r), f"x{x}", int(t)) for r, x, t in zip(rng.integers(0, 2, 4000), rng.integers(0, 2, 4000), rng.integers(0, 900_000, 4000), strict=True)] + [(0, "x0", 5000)] * 50
    windows = []
    for k in range(200):
        a = int(rng.integers(0, 900_000)) if k % 5 else 5000
        windows.append((k, k % 2, f"x{k % 3}", a, None if k % 7 == 0 else a + int(rng.choice([0, 10, 999, 1000, 5000, 700_000]))))
    e = spark.createDataFrame(events, "run_id int, receiver_id string, t_us long").repartition(5)
    w = spark.createDataFrame(windows, "id int, run_id int, receiver_id string, t_start_us long, t_end_us long")
    got = {r.id: r.events for r in views.coverage_by_time(w, e).collect()}
    assert got == {i: sum(r == run and x == rx and a <= t <= (2**63 if b is None else b) for run, rx, t in events) for i, r, x, a, b in windows}


def test_overlaps_meet_once(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"s{k % 2}", int(a), int(a) + int(n)) for k, (a, n) in enumerate(zip(rng.integers(0, 2_000_000, 120), rng.choice([0, 5000, 99_999, 100_000, 350_000], 120), strict=True))]
    got = Counter(map(tuple, bandplan.overlaps(spark.createDataFrame(rows, "id int, service string, freq_lo_hz long, freq_hi_hz long")).select("a", "b").collect()))
    assert got == Counter((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])


def test_overlaps_of_dense_and_wide_plans(spark):
    """Ranges of any width, odd ones too; beginnings meet few ranges that don't hold them."""
    rng = np.random.default_rng(4)
    rows = [(k, "s", int(a), int(a) + int(n)) for k, (a, n) in enumerate(zip(rng.integers(-9000, 9000, 600), rng.choice([0, 1, 7, 80, 500], 600), strict=True))]
    rows += [(600, "s", -(2**55), 2**55), (601, "s", 100, 50), (602, "s", 40, 2**40), (603, "s", None, 5), (604, "s", 5, None), (605, None, 0, 90), (606, "t", 0, 90), (607, "s", 40, 2**40), (607, "s", 41, 50)]
    plan = spark.createDataFrame(rows, "id int, service string, freq_lo_hz long, freq_hi_hz long")
    got = Counter(map(tuple, bandplan.overlaps(plan).select("a", "b").collect()))
    known = [r for r in rows if None not in r[1:3]]
    reach = lambda a, b: a[2] is not None and b[3] is not None and a[2] <= b[3]
    assert got == Counter((a[0], b[0]) for a in known for b in known if a[0] < b[0] and a[1] == b[1] and reach(a, b) and reach(b, a))
    dense = spark.range(4000).selectExpr("id", "'s' AS service", "id * 25 AS freq_lo_hz", "id * 25 + 60 + id % 900 AS freq_hi_hz")
    begun, held = bandplan.listed(dense)
    assert begun.join(held, ["service", "size", "bucket"]).count() < 4 * bandplan.overlaps(dense).count()


def test_nearest_inputs_of_crowded_channels(spark):
    """Against all pairs, with ties, copies and odd rows; what is within the lag is never joined."""
    rng = np.random.default_rng(5)
    rows = [(k, int(t), int(c)) for k, (t, c) in enumerate(zip(rng.integers(-400, 400, 900), rng.choice([10, 20, 30], 900), strict=True))]
    rows += [(900, None, 10), (901, None, 20), (902, 5, None), (903, 5000, 10), (904, 5041, 20), (905, 9000, 10), (906, 9040, 20), (906, 9040, 20), (903, 4999, 10)]
    events = spark.createDataFrame(rows, "id long, t_us long, channel_hz long").repartition(5)
    pairs = [(10, 20), (10, 30), (20, 30), (10, 20), (30, 30), (10, 40)]
    got = Counter(map(tuple, enrich.pair_nearest(events, spark.createDataFrame(pairs, "output_hz long, input_hz long"), 40).collect()))
    want: dict = {}
    for a, b in set(pairs):
        for i, t, c in rows:
            for j, u, d in rows:
                if c == a and d == b and t is not None and u is not None and abs(t - u) <= 40:
                    want[a, b, i] = min(want.get((a, b, i), (99,)), (abs(t - u), u, j, t - u))
    assert got == Counter((*k, v[2], v[3]) for k, v in want.items())
    hot = spark.range(20_000).selectExpr("id", "id div 2 AS t_us", "if(id % 2 = 0, 10L, 20L) AS channel_hz")  # 10,000 inputs within the lag of each output
    df = enrich.pair_nearest(hot, spark.createDataFrame(pairs[:1], "output_hz long, input_hz long"), 1_000_000)
    assert "step" not in df._jdf.queryExecution().optimizedPlan().toString() and df.where("lag_us = 0 AND in_id = out_id + 1").count() == 10_000
