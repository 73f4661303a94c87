"""Frames out of order, flagged and detected in a stream; restarts; stops."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import detect, excerpts
from bandloom.plans.queries import QUERIES
from bandloom.streaming import detector, excerpt, receiver, watch

FRAMES = "receiver_id string, window_id long, frame_no long, frame_start long, at timestamp, power_db array<double>, wideband_db double, clip_frac double"


@pytest.fixture(scope="module")
def rotation(spark):
    """Two receivers that turn between three windows; signals, a loud spell, a few clipped frames."""
    rng = np.random.default_rng(9)
    rows = []
    for rx in ("uhf", "vhf"):
        for k in range(900):
            window, no = k // 150 % 3, k // 450 * 150 + k % 150
            power = (-90 + rng.normal(size=4) * 0.5).tolist()
            if k % 150 in range(60, 90) or (k // 150 == 2 and k % 150 > 120):
                power[1 + window] += 30.0
            level = -88.0 + float(rng.normal()) * 0.1 + (12.0 if 400 <= k < 430 else 0.0)
            rows.append((rx, window, no, k * 1000, k * 0.04, power, level, 0.01 if k % 211 == 0 else 0.0))
    df = spark.createDataFrame(rows, FRAMES.replace("at timestamp", "at double"))
    return df.withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long") + 1_700_000_000_000_000)).cache()


def by_hand(rows) -> tuple[dict, list[tuple]]:
    """Flags by frame, and events by one detector for each stay in a window."""
    flags, events = {}, []
    for rx in ("uhf", "vhf"):
        past, d, at = [], None, None
        for r in sorted((r for r in rows if r.receiver_id == rx), key=lambda r: r.frame_start):
            past = [*past, r.wideband_db][-300:]
            base = float(np.percentile(past, 20)) if len(past) >= 60 else None
            flag = int((base is not None and r.wideband_db - base > 6) or r.clip_frac > 1e-4)
            flags[rx, r.frame_start] = flag
            if r.window_id != at:
                events += [(rx, at, *e) for e in (d.leave(r.frame_start) if d else [])]
                d, at = detector.Detector(3, 8), r.window_id
            events += [(rx, at, *e) for e in d.frame(np.array(r.power_db), r.frame_start, flag)]
    return flags, events


def test_frames_out_of_order_are_flagged_and_detected_in_order(spark, rotation):
    flags, events = by_hand(rotation.collect())
    ready = detector.shuffled(rotation, lambda s: receiver.in_order(s, "4 seconds"), 5, 4.0).collect()
    seen = {(r.receiver_id, r.frame_start): r.overload for r in ready if r.power_db is not None}
    assert seen == flags and 0 < sum(flags.values()) < len(flags) / 4 and len(ready) == 2 * (900 + 5)
    log = detector.shuffled(rotation, lambda s: detector.detect_stream(receiver.in_order(s, "4 seconds"), 0.04, log=True), 5, 4.0)
    got = sorted((r.receiver_id, r.window_id, r.channel, r.start, r.end, r.overload, r.closed) for r in detector.standing(log).collect())
    want = sorted((rx, w, c, start, end, flag, closed) for rx, w, c, start, end, _, flag, closed in events)
    assert got == want and {x[-1] for x in got} == {True, False} and {x[-2] for x in got} == {0, 1}
    steps = {r.step: r["count"] for r in log.groupBy("step").count().collect()}
    assert steps == {"open": len(want), "end": len(want)}


def test_flags_of_the_stream_are_those_of_the_table(spark, rotation):
    table = detect.overload_flags(rotation, "receiver_id", ["frame_start"], "wideband_db", "clip_frac")
    flags, _ = by_hand(rotation.collect())
    assert {(r.receiver_id, r.frame_start): r.overload for r in table.collect()} == flags


def started(spark, path, job, name):
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return job(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").queryName(name)


def test_an_open_event_outlives_a_crash(spark, rotation, tmp_path):
    mine = rotation.where("receiver_id = 'uhf'").withColumn("overload", F.lit(0))
    job = lambda s: detector.detect_stream(s, 0.04, log=True)
    with detector.rocksdb(spark):
        for part, want in (("frame_start <= 70000", [None]), ("frame_start between 71000 and 140000", [90_000])):
            mine.where(part).drop("overload").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = started(spark, tmp_path, job, "crash").trigger(availableNow=True).start()
            q.awaitTermination()
            now = detector.standing(spark.read.schema(detector.LOG).parquet(f"{tmp_path}/out")).collect()
            assert [(r.channel, r.start, r.end) for r in now] == [(1, 60_000, e) for e in want]


def test_many_receivers_share_the_keys_of_the_state(spark, tmp_path):
    """A thousand receivers, whose frames come in three batches, with the flags of the table and no state or timer for each of them."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("k") * 1_000_000)
    level = F.when((F.col("rx") + F.col("k")) % 37 == 0, -70.0).when(F.col("rx") % 11 == 5, None).otherwise(-90.0 + F.pmod(F.xxhash64("rx", "k"), F.lit(100)) / 100)
    rows = spark.range(1000).withColumnRenamed("id", "rx").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(69)).cast("array<long>")))
    name = F.when(F.col("rx") > 0, F.concat(F.lit("rx"), "rx"))  # one has none
    frames = rows.select("k", name.alias("receiver_id"), F.lit(0).cast("long").alias("window_id"), F.col("k").alias("frame_no"), F.col("k").alias("frame_start"), at.alias("at"), F.array(level).alias("power_db"), level.alias("wideband_db"), F.lit(0.0).alias("clip_frac"))
    with detector.rocksdb(spark):
        for part in ("k < 30 OR k = 35", "k >= 30 AND k < 50 AND k <> 35 OR k = 55", "k >= 50 AND k <> 55"):
            frames.where(part).drop("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = started(spark, tmp_path, lambda s: receiver.in_order(s, "10 seconds"), "many").trigger(availableNow=True).start()
        q.awaitTermination()
        assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * receiver.BUCKETS
        frames.limit(1).withColumns({"frame_start": F.lit(9999).cast("long"), "at": at + F.expr("INTERVAL 1 HOUR")}).drop("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        started(spark, tmp_path, lambda s: receiver.in_order(s, "10 seconds"), "many").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(receiver.READY).parquet(f"{tmp_path}/out").collect()
    want = detect.overload_flags(frames, "receiver_id", ["frame_start"], "wideband_db", "clip_frac").collect()
    assert {(r.receiver_id, r.frame_start, r.baseline, r.overload, *r.power_db) for r in out} == {(r.receiver_id, r.frame_start, r.baseline, r.overload, *r.power_db) for r in want}
    assert len(out) == 70_000 and sum(r.overload for r in out) > 0


def test_a_slice_of_many_files_is_one_batch(spark, rotation, monkeypatch):
    """Slices of several files, one of them with fewer rows than files, give what slices of one file do."""
    job = lambda s: receiver.in_order(s, "4 seconds")
    monkeypatch.setattr(detector, "FILE_ROWS", 30)
    few = rotation.repartition(10).where("frame_start < 30000 OR frame_start BETWEEN 300000 AND 302000 OR frame_start > 500000")
    for frames in (rotation.repartition(10), few):
        out = detector.shuffled(frames, job, 5, 4.0)
        files = max(1, frames.count() // (5 * 30))
        folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        assert files > 1 and len([f for f in os.listdir(f"{folder}/in") if f.endswith(".parquet")]) == 5 * files + 1
        flags, _ = by_hand(frames.collect())
        assert {(r.receiver_id, r.frame_start): r.overload for r in out.where("power_db is not null").collect()} == flags


def test_late_frames_are_dropped_and_counted(spark, rotation, tmp_path):
    mine = rotation.where("receiver_id = 'uhf'")
    parts = ["frame_start between 300000 and 500000", "frame_start between 501000 and 600000", "frame_start < 20000", "frame_start > 600000"]
    with detector.rocksdb(spark):
        for part in parts:
            mine.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        job = lambda s: receiver.in_order(receiver.counted(s.withColumn("overflows", F.lit(2))), "1 second")
        q = started(spark, tmp_path, job, "late").trigger(availableNow=True).start()
        q.awaitTermination()
    said = receiver.losses(q.recentProgress)
    assert said == {"frames": 600 + 20, "overflows": 2 * (600 + 20), "late": 20}
    out = spark.read.schema(receiver.READY).parquet(f"{tmp_path}/out").where("power_db is not null")
    assert out.agg(F.min("frame_start")).first()[0] == 300_000


def test_a_dry_source_stops_the_query_and_its_state_goes_on(spark, rotation, tmp_path):
    mine = rotation.where("receiver_id = 'uhf' and frame_start <= 140000")
    job = lambda s: detector.detect_stream(s, 0.04, log=True)
    mine.where("frame_start <= 70000").coalesce(1).write.parquet(f"{tmp_path}/in")
    w = watch.Watch(spark, limit=2)
    spark.streams.addListener(w)
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "200")
    try:
        with detector.rocksdb(spark):
            q = started(spark, tmp_path, job, "dry").trigger(processingTime="200 milliseconds").start()
            assert q.awaitTermination(60) and q.exception() is None
            assert w.reasons == {str(q.id): "no frames in 2 triggers"}
            w.limit = 1000
            w.reasons.clear()
            mine.where("frame_start > 70000").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = started(spark, tmp_path, job, "dry").trigger(processingTime="200 milliseconds").start()
            until = time.monotonic() + 60
            while time.monotonic() < until and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.2)
            assert watch.stopped(q) and not q.isActive and not w.reasons
    finally:
        spark.streams.removeListener(w)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    now = detector.standing(spark.read.schema(detector.LOG).parquet(f"{tmp_path}/out")).collect()
    assert [(r.channel, r.start, r.end, r.closed) for r in now] == [(1, 60_000, 90_000, True)]


def test_excerpts_of_a_stream_equal_those_of_the_table(spark):
    """Long, short, and open events; each once, with samples from before its start; none that is too short; nulls once they are gone."""
    n, frame_s = 10, 0.1
    times = {"dwell_s": 2.0, "pre_s": 1.0, "least_s": 1.2, "hang_s": 0.3}
    on = {0: range(60, 75), 1: range(62, 66), 2: range(100, 160), 3: range(190, 200), 4: [*range(40, 50), *range(120, 130)]}
    rows = []
    for k in range(200):
        power = [-90.0 + (30.0 if k in on[c] else 0.0) + 0.01 * (k % 3) for c in range(5) for _ in (0, 1)]
        rows.append(("uhf", 0, k, k * n, power, 0, [float(k * n + j) for j in range(n)], [0.5] * n))
    frames = spark.createDataFrame(rows, "receiver_id string, window_id long, frame_no long, frame_start long, power_db array<double>, overload int, i array<float>, q array<float>")
    log = detector.standing(detector.detect(frames, frame_s, log=True)).withColumn("written", F.lit(200 * n)).withColumn("id", F.struct("channel", "start"))
    wanted = excerpts.ranges(log, n / frame_s, **times).select("id", "receiver_id", "window_id", "first", "length")
    want = sorted((tuple(r.id), r.first, r.length, tuple(r.i)) for r in excerpts.fetched(wanted, frames, n).where("length is not null").collect())
    parts = [frames.where(f"frame_no between {a} and {b}").coalesce(1) for a, b in ((0, 63), (64, 109), (110, 199))]
    out = detector.drained(frames, parts, lambda s: excerpt.excerpted(s, frame_s, n, **times), "excerpts").collect()
    assert sorted(((r.channel, r.start), r.first, r.length, tuple(r.i)) for r in out) == want and len(want) >= 4
    assert len({(r.channel, r.start) for r in out}) == len(out) and min(r.length for r in out) < max(r.length for r in out) == 300
    short = detector.drained(frames.where("frame_no <> 55"), [frames.where("frame_no <> 55")], lambda s: excerpt.excerpted(s, frame_s, n, **times), "excerpts").collect()
    lost = {(r.channel, r.start) for r in short if r.i is None}
    assert lost and lost == {(r.channel, r.start) for r in out if r.first // n <= 55 <= (r.first + r.length - 1) // n}


def test_query_of_excerpts_equals_the_table(spark, sf_dir):
    got = QUERIES["excerpt_stream"](spark, sf_dir).collect()
    assert got and len({(r.receiver_id, r.window_id, r.channel, r.start) for r in got}) == len(got)
    assert all(r.samples == r.length and r.mean_db > -90.0 for r in got)
