from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom import schemas
from bandloom.operators import bandplan, capture, lifecycle, mutations
from bandloom.sources import profile, seed, warehouse


def test_seeded_plan(spark):
    p = seed.seeded(spark).cache()
    assert {(r.kind, r["count"]) for r in p.groupBy("kind").count().collect()} == {("channel", 85), ("segment", 32)}
    assert {r.pair_offset_hz for r in p.select("pair_offset_hz").distinct().collect()} == {None, 5_000_000, 600_000}
    assert {r.rule: r.n for r in schemas.violations(p, schemas.checks("band_plan")).collect()} == dict.fromkeys(schemas.checks("band_plan"), 0)
    assert schemas.duplicates(p, schemas.UNIQUE["band_plan"]).count() == 0
    assert bandplan.overlaps(p.where("kind = 'channel'")).count() == 0
    width = {r.label: r.freq_hi_hz - r.freq_lo_hz for r in p.collect()}
    assert width["FRS 1"] == width["GMRS 20"] == 12_499 and width["Itinerant 151.505"] == 7_499
    f = spark.createDataFrame([(146_519_400,), (146_470_000,), (462_675_400,), (463_112_500,), (433_920_000,)], "freq_hz long")
    best = {r.freq_hz: r.label for r in bandplan.best(f, p).collect()}
    assert best == {146_519_400: "2 m national FM simplex calling", 146_470_000: "2 m simplex", 462_675_400: "FRS 20", 433_920_000: "70 cm auxiliary and repeater links"}
    assert [[t.label for t in r.tied] for r in bandplan.tied(f.where("freq_hz = 462675400"), p).collect()] == [["FRS 20", "GMRS 20"]]


PROFILE = """
receivers:
  uhf: {center_hz: 466_000_000, label: upper, gain: 0, sample_rate: 0, serial: abc, antenna: whip}
  vhf: {mode: rotating, windows: [{center_hz: 146000000, label: 2 m}, {center_hz: 154950000}], dwell_seconds: 30}
  still: {mode: rotating, windows: [{center_hz: 146000000}, {center_hz: 154950000}]}
  none: {}
  empty: {mode: rotating}
  vague: {mode: rotating, windows: [{label: x}]}
  text: nothing
detection: {on_db: 12, hang_s: 0.5}
operator: {licences: [gmrs, ham2m]}
"""


def test_profile():
    r = profile.load(PROFILE, "uhf")
    assert r.windows == (profile.Window(466_000_000, "upper"),) and (r.gain, r.sample_rate, r.serial, r.antenna, r.ppm) == (0.0, 10e6, "abc", "whip", 0.0)
    assert (r.on_db, r.off_db, r.min_duration_s, r.hang_s) == (12.0, 6.0, 0.12, 0.5)
    v = profile.load(PROFILE, "vhf")
    assert (v.gain, v.dwell_seconds, [w.label for w in v.windows]) == (12.0, 30.0, ["2 m", None]) and profile.resolved(v) == v
    parked = profile.resolved(v, freq_hz=146_520_000, gain=0.0, serial=None)
    assert parked.windows == (profile.Window(146_520_000, "--freq"),) and parked.mode == "parked" and parked.gain == 0
    assert profile.licences(PROFILE) == ("gmrs", "ham2m") and profile.licences("") == ()
    assert len(profile.resolved(profile.load(PROFILE, "still"), dwell_seconds=5.0).windows) == 2
    with pytest.raises(ValueError, match="dwell_seconds"):
        profile.resolved(profile.load(PROFILE, "still"))
    for name, said in (("none", "no center_hz"), ("absent", "no receiver"), ("empty", "no windows"), ("vague", "needs a center_hz"), ("text", "not a table")):
        with pytest.raises(ValueError, match=said):
            profile.load(PROFILE, name)


def test_capture_files_and_budget(spark):
    rate, n = 24_000.0, 24_000
    rows = [(k, [2500.0] * n, [1.0] * n, [0.0] * n, rate) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, audio_hz array<double>, i array<double>, q array<double>, rate double")
    files = {r.id: r for r in capture.recorded(df).collect()}
    with wave.open(io.BytesIO(bytes(files[0].audio))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 8000)
        pcm = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    assert abs(np.median(pcm) - 16_384) < 20
    loaded = np.load(io.BytesIO(bytes(files[1].iq)))
    assert loaded["baseband"].dtype == np.complex64 and len(loaded["baseband"]) == n and loaded["fs"] == rate
    one = 16_000 + 44 + n * 8 + 600
    assert [r.id for r in capture.within_budget(df, 2 * one).orderBy("id").collect()] == [0, 1] and capture.within_budget(df, one - 1).count() == 0


def test_warehouse_is_created_upgraded_and_guarded(spark, tmp_path):
    at = f"file://{tmp_path}/w"
    assert warehouse.version(spark, at) is None and warehouse.ensure(spark, at) == 8
    assert warehouse.version(spark, at) == 8 and set(schemas.TABLES) == set(warehouse.manifest(spark, at)["tables"])
    mutations.appended([{"id": 1, "run_id": 7, "receiver_id": "uhf", "t_start": 0.0, "freq_hz": 1, "overload": 0}], "events", spark, warehouse.folder(spark, at, "events"))
    with pytest.raises(ValueError, match="events.run_id"):
        warehouse.ensure(spark, at)
    warehouse.committed(spark, at, {"runs": spark.createDataFrame([(7, 1.0)], "id long, started_at double")})
    assert warehouse.ensure(spark, at) == 8 and warehouse.table(spark, at, "events").count() == 1
    with pytest.raises(ValueError, match="older"):
        warehouse.ensure(spark, at, 7)
    old = f"file://{tmp_path}/old"
    spark.createDataFrame([(1, 88.5, None), (2, None, 23), (3, None, None)], "id long, ctcss_hz double, dcs_code int").write.parquet(f"{old}/events")
    warehouse.committed(spark, old, {}, 2)
    assert warehouse.ensure(spark, old) == 2 and warehouse.version(spark, old) == 8
    rows = {r.id: r for r in warehouse.table(spark, old, "events").collect()}
    assert [rows[k].tone_state for k in (1, 2, 3)] == ["ctcss", "dcs", "unknown"] and rows[1].window_id is None


def test_a_change_of_several_tables_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/w"
    warehouse.ensure(spark, at)
    rows = lambda n: {"runs": spark.range(n).selectExpr("id", "0.0D AS started_at"), "decodes": spark.range(n).selectExpr("id", "id AS event_id")}
    seen = lambda: [warehouse.table(spark, at, t).count() for t in ("runs", "decodes")]
    first = warehouse.committed(spark, at, rows(3))
    assert seen() == [3, 3]
    bad = rows(5) | {"decodes": spark.range(5).selectExpr("assert_true(id < 4) IS NULL AS x")}
    with pytest.raises(Exception, match="is not true"):
        warehouse.committed(spark, at, bad)  # stopped between two tables
    assert seen() == [3, 3]
    now = warehouse.manifest(spark, at)
    monkeypatch.setattr(warehouse, "manifest", lambda *_: now)
    warehouse.committed(spark, at, rows(6))
    with pytest.raises(ValueError, match="meanwhile"):
        warehouse.committed(spark, at, rows(7))  # began from the same state
    monkeypatch.undo()
    assert seen() == [6, 6] and warehouse.manifest(spark, at)["number"] == first + 1
    assert len(warehouse.vacuumed(spark, at)) >= 5 and seen() == [6, 6] and warehouse.vacuumed(spark, at) == []


@pytest.mark.parametrize("stop", ["before", "between", "after"])
def test_a_stopped_swap_loses_nothing(spark, tmp_path, stop):
    path, at = tmp_path / "t", f"file://{tmp_path}/t"
    mutations.swapped(spark.range(3), at)
    spark.range(5).write.parquet(f"{at}.new")
    if stop == "before":  # the new table is not whole
        (tmp_path / "t.new" / "_SUCCESS").unlink()
        path.rename(tmp_path / "t.old")
    elif stop == "between":
        path.rename(tmp_path / "t.old")
    else:
        path.rename(tmp_path / "t.old")
        (tmp_path / "t.new").rename(path)
    mutations.recovered(spark, at)
    assert spark.read.parquet(at).count() == (3 if stop == "before" else 5)
    mutations.swapped(spark.range(7), at)
    assert spark.read.parquet(at).count() == 7 and {p.name for p in tmp_path.iterdir()} == {"t"}


def test_ensure_ends_a_stopped_swap(spark, tmp_path):
    at = f"file://{tmp_path}/w"
    spark.createDataFrame([(7, 1.0)], "id long, started_at double").write.parquet(f"{at}/runs.old")
    spark.createDataFrame([(7, 1.0), (8, 2.0)], "id long, started_at double").write.parquet(f"{at}/runs.new")
    warehouse.ensure(spark, at)
    assert warehouse.table(spark, at, "runs").count() == 2


def test_runs_and_windows(spark):
    runs = spark.createDataFrame([(1, "pi", "uhf: {}"), (2, "pi", "vhf: {}")], "id long, host string, profile_yaml string")
    got = {r.id: r for r in lifecycle.folded(lifecycle.run_started(runs, 10.0), lifecycle.run_ended(runs.where("id = 1"), 20.0)).collect()}
    assert (got[1].started_at, got[1].ended_at, got[1].profile_yaml) == (10.0, 20.0, "uhf: {}") and got[2].ended_at is None
    w = spark.createDataFrame([(1, 1, "uhf", 466_000_000), (2, 1, "uhf", 467_000_000)], "id long, run_id long, receiver_id string, center_hz long")
    got = {r.id: (r.t_start, r.t_end) for r in lifecycle.folded(lifecycle.window_opened(w, 1.0), lifecycle.window_closed(w.where("id = 1"), 2.0)).collect()}
    assert got == {1: (1.0, 2.0), 2: (1.0, None)}
    assert lifecycle.folded(lifecycle.run_started(runs)).first().started_at > 1.7e9


def test_free_disk_limits_captures(spark):
    df = spark.range(5).selectExpr("id", "array_repeat(0.0D, 24000) AS i", "24000.0D AS rate")
    size = 24_000 / 24_000 * 16_000 + capture.WAV_HEADER + 24_000 * 8 + capture.NPZ_HEADER
    assert capture.within_budget(df, int(3 * size)).count() == 3
    assert capture.within_budget(df, int(9 * size), free=capture.LEAST_FREE + int(2 * size)).count() == 2 and capture.within_budget(df, int(9 * size), free=10).count() == 0


def test_old_names_and_notes(spark):
    notes = {r.label: r.notes for r in seed.seeded(spark).collect()}
    assert notes["GMRS 16"] == "50 W, repeater output; legacy White Dot — preprogrammed on cheap radios" and notes["GMRS 15"] == "50 W, repeater output"
    assert notes["MURS 570"] == "20 kHz bandwidth; legacy Blue Dot, moved from Part 90 in 2002" and notes["MURS 820"] == "11.25 kHz bandwidth"
    assert notes["2 m FM repeater outputs"] == "600 kHz standard offset" and notes["APRS (North America)"] == "packet, not voice" and notes["2 m simplex"] is None


def test_receivers_are_registered_by_serial(spark):
    rows = spark.createDataFrame([(1, "uhf", "A1", 466_000_000), (1, "vhf", "B2", None)], "run_id long, receiver_id string, serial string, center_hz long")
    got = {r.receiver_id: r for r in lifecycle.registered(rows).collect()}
    assert (got["uhf"].serial, got["uhf"].center_hz, got["vhf"].center_hz, got["uhf"].gain_db) == ("A1", 466_000_000, None, None)
    with pytest.raises(ValueError, match="usb_index"):
        lifecycle.registered(rows.withColumn("usb_index", F.lit(0)))
    with pytest.raises(Exception, match="no serial of receiver vhf"):
        lifecycle.registered(rows.withColumn("serial", F.when(F.col("receiver_id") == "uhf", F.col("serial")))).collect()


def test_a_center_twice_is_refused(spark):
    rows = spark.createDataFrame([("frs", 1000, 100), ("frs", 1000, 100), ("frs", 2000, 100), ("gmrs", 1000, 100)], "service string, center long, bandwidth long")
    assert [tuple(r) for r in bandplan.duplicate_centers(rows).collect()] == [("frs", 1000, 2)]
    with pytest.raises(Exception, match="frs has a center twice: 1000"):
        bandplan.nominal_windows(rows).collect()
    assert bandplan.nominal_windows(rows.dropDuplicates()).count() == 3


def test_views_and_tables_of_each_version(spark, tmp_path):
    at = f"file://{tmp_path}/w"
    warehouse.ensure(spark, at, 6)
    assert "coverage_windows" not in warehouse.manifest(spark, at)["tables"] and warehouse.register_views(spark, at) == ["v_activity", "v_contactable", "v_events"]
    warehouse.ensure(spark, at, 7)
    new = {
        "runs": spark.createDataFrame([(1, 0.0)], "id long, started_at double"),
        "coverage_windows": spark.createDataFrame([(5, 1, "uhf", 466_000_000, "a", 0.0, 100.0), (6, 1, "uhf", 467_000_000, None, 100.0, None)], "id long, run_id long, receiver_id string, center_hz long, label string, t_start double, t_end double"),
        "channels": spark.createDataFrame([(1, 462_675_000, "gmrs", "GMRS 20", 4, "ctcss", 141.3), (2, 467_675_000, "gmrs", "input", 0, "none", None)], "id long, freq_hz long, service string, label string, tier int, tone_state string, ctcss_hz double")
        .withColumns({"dcs_code": F.lit(None).cast("int"), "dcs_polarity": F.lit(None).cast("string"), "total_airtime_s": F.lit(2.5), "event_count": F.lit(2).cast("long")}),
        "pairs": spark.createDataFrame([(1, 1, 2, 5_000_000)], "id long, output_channel_id long, input_channel_id long, offset_hz long"),
        "events": spark.createDataFrame([(1, 1, "uhf", 10.0, 462_675_000, 2.5, 1), (2, 1, "uhf", 120.0, 462_675_000, None, 1), (3, 1, "vhf", 10.0, 462_675_000, 1.0, None)], "id long, run_id long, receiver_id string, t_start double, freq_hz long, duration_s double, channel_id long")
        .withColumns({c: F.lit(None).cast(t) for c, t in (("ctcss_hz", "double"), ("dcs_code", "int"), ("dcs_polarity", "string"), ("tone_state", "string"), ("snr_db", "double"), ("deviation_hz", "double"), ("band_plan_id", "long"))}).withColumn("overload", F.lit(0)),
    }
    warehouse.committed(spark, at, new)
    assert warehouse.register_views(spark, at) == sorted(schemas.VIEWS)
    assert [(r.at, r.state, r.label) for r in spark.sql("SELECT * FROM v_events WHERE id < 3 ORDER BY id").collect()] == [("1970-01-01 00:00:10", "closed", "GMRS 20"), ("1970-01-01 00:02:00", "open", "GMRS 20")]
    assert spark.sql("SELECT hits, airtime_s FROM v_activity").first() == (3, 3.5)
    assert [(r.freq_hz, r.input_hz, r.tone) for r in spark.sql("SELECT * FROM v_contactable").collect()] == [(462_675_000, 467_675_000, "CTCSS 141.3"), (467_675_000, None, "no tone")]
    by_time = {(r.center_hz, r.windows, r.listened_us, r.events) for r in spark.sql("SELECT * FROM v_coverage").collect()}
    assert by_time == {(466_000_000, 1, 100_000_000, 1), (467_000_000, 1, 0, 1)}
    assert warehouse.ensure(spark, at) == 7  # events get window_id, which is null: nothing was heard in a known window
    warehouse.register_views(spark, at)
    assert {(r.center_hz, r.label, r.events) for r in spark.sql("SELECT * FROM v_coverage").collect()} == {(466_000_000, "a", 0), (467_000_000, "467.000 MHz", 0)}
