"""Ordered windows in many parts equal plain windows; a hot key is spread."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bandloom.operators import detect, ordered, views
from bandloom.operators.ordered import Ordered
from bandloom.plans.queries import ORACLES, QUERIES
from bandloom.streaming.receiver import Monitor


def by_key():
    return Window.partitionBy("key").orderBy("at")


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small tables would be coalesced to one part, and nothing be carried."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.fixture(scope="module")
def table(spark):
    """A third of the rows have one key, many have keys of their own; long runs; nulls in keys and values."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(3000):
        key = 1 if k % 3 == 0 else None if k % 31 == 0 else int(rng.integers(0, 40))
        hot = 300 < k < 2600 and key == 1  # a run longer than a part
        rows.append((key, k, None if k % 17 == 0 and not hot else float(rng.integers(50, 60) if hot else rng.integers(0, 60)), k * 10))
    return spark.createDataFrame(rows, "key int, at long, v double, start long").repartition(7).cache()


def as_set(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_hot_key_is_spread(table):
    o = Ordered(table, ["key"], ["at"])
    sizes = sorted(r["count"] for r in o.rows.groupBy(ordered.PART).count().collect())
    assert len(sizes) >= 6 and sizes[-1] <= 2 * 3000 / len(sizes)
    assert o.rows.where("key = 1").select(ordered.PART).distinct().count() >= 3


def test_running_sums_runs_and_last_values(table):
    o = Ordered(table, ["key"], ["at"])
    mine = o.runs(o.running(o.rows, {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}), {"hot": F.col("v") >= 20, "cold": F.col("v") < 30})
    mine = o.latest(mine, "seen", F.when(F.col("v") > 55, F.col("at")), F.lit(-1))
    upto = by_key().rowsBetween(Window.unboundedPreceding, 0)
    plain = table.withColumns({"s": F.sum(F.coalesce("v", F.lit(0.0))).over(upto), "n": F.count(F.lit(1)).over(upto), "seen": F.coalesce(F.last(F.when(F.col("v") > 55, F.col("at")), True).over(upto), F.lit(-1))})
    plain = plain.withColumn("seen_before", F.coalesce(F.lag("seen").over(by_key()), F.lit(-1)))
    for name, c in (("hot", F.col("v") >= 20), ("cold", F.col("v") < 30)):
        plain = plain.withColumn("_i", F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).over(upto))
        plain = plain.withColumn(name, F.sum(F.when(c, 1).otherwise(0)).over(Window.partitionBy("key", "_i").orderBy("at")))
    columns = ("key", "at", "s", "n", "hot", "cold", "seen", "seen_before")
    assert as_set(mine, *columns) == as_set(plain, *columns) and mine.agg(F.max("hot")).first()[0] > 700


def test_values_still_to_come(table):
    o = Ordered(table, ["key"], ["at"])
    value = F.when(F.col("at") % 401 == 0, F.struct("at", "v"))
    mine = o.upcoming(o.rows, "next", value)
    plain = table.withColumn("next", F.first(value, True).over(by_key().rowsBetween(0, Window.unboundedFollowing)))
    assert as_set(mine, "key", "at", "next") == as_set(plain, "key", "at", "next") and mine.where("next IS NOT NULL").count() > 900


@pytest.mark.parametrize("back", [{"a": 0, "b": 1}, {"a": 3, "b": 700}])
def test_values_some_rows_back(table, back):
    o = Ordered(table, ["key"], ["at"])
    mine = o.lagged(o.rows, "start", back)
    first = F.first("start").over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    plain = table.withColumns({n: F.coalesce(F.lag("start", k).over(by_key()), first) for n, k in back.items()})
    assert as_set(mine, "key", "at", *back) == as_set(plain, "key", "at", *back)


def test_tracker_equals_a_loop(table):
    got = sorted((r.key, r.event_no, r.start, r.end, r.peak) for r in detect.tracked(table.where("key is not null"), "key", ["at"], "v", "start", 40, 25, 2, 3).collect())
    want = []
    rows = sorted(table.where("key is not null").collect(), key=lambda r: (r.key, r.at))
    for key in sorted({r.key for r in rows}):
        on, above, below, no, starts = False, 0, 0, 0, []
        for r in (r for r in rows if r.key == key):
            starts.append(r.start)
            above = above + 1 if r.v is not None and r.v >= 40 else 0
            below = below + 1 if r.v is not None and r.v < 25 else 0
            if not on and above >= 2:
                on, no = True, no + 1
                want.append([key, no, starts[-2], None, None])
            elif on and below >= 3:
                on = False
                want[-1][3] = starts[-3]
            if on and r.v is not None:
                want[-1][4] = max(want[-1][4] or 0.0, r.v)
    assert got == sorted(map(tuple, want), key=lambda x: x[:2]) and len(got) > 50


def test_sliding_order_statistics(table, monkeypatch):
    monkeypatch.setattr(ordered, "SPAN", 150)
    rows = table.withColumn("clip", F.lit(0.0))
    floors = {(r.key, r.at): r.floor for r in detect.rolling_floor(rows, "key", ["at"], "v").collect()}
    flags = {(r.key, r.at): (r.baseline, r.overload) for r in detect.overload_flags(rows, "key", ["at"], "v", "clip").collect()}
    by: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.at):
        past = by.setdefault(r.key, [])
        past.append(r.v)
        w = sorted(v for v in past[-120:] if v is not None)
        assert floors[r.key, r.at] == (w[min(30, len(w) - 1)] if len(w) >= 20 else None)
        w = [v for v in past[-300:] if v is not None]
        base = float(np.percentile(w, 20)) if len(w) >= 60 else None
        got = flags[r.key, r.at]
        assert (got[0] is None) == (base is None) and (base is None or abs(got[0] - base) < 1e-9)
        assert got[1] == int(base is not None and r.v is not None and r.v - base > 6)
    assert len(floors) == 3000


def test_sliding_statistics_keep_other_columns(spark):
    df = spark.createDataFrame([(1, k, float(k), "t", None if k % 2 else 7, [k]) for k in range(40)], "key int, at long, v double, name string, few int, list array<int>")
    out = detect.rolling_floor(df, "key", ["at"], "v")
    assert out.columns == [*df.columns, "floor"] and sorted(map(str, out.drop("floor").collect())) == sorted(map(str, df.collect()))
    nan = df.withColumn("v", F.when(F.col("at") == 5, F.lit(float("nan"))).otherwise(F.col("v")))
    assert detect.rolling_floor(nan, "key", ["at"], "v").where("at = 39").first().floor == 31.0


def test_exact_medians(spark, table):
    got = {r.key: (r.m, r.s, r.none) for r in ordered.medians(table, ["key"], {"m": F.col("v"), "s": F.col("start"), "none": F.lit(None)}).collect()}
    want = {r.key: (r.m, r.s, None) for r in table.groupBy("key").agg(F.median("v").alias("m"), F.median("start").alias("s")).collect()}
    assert got == want
    two = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (3, None)], "k int, v double")
    assert {r.k: r.m for r in ordered.medians(two, ["k"], {"m": F.col("v")}).collect()} == {1: 1.5, 2: 5.0, 3: None}
    assert ordered.medians(two.where("false"), ["k"], {"m": F.col("v")}).count() == 0


def test_windows_of_seconds_over_one_busy_receiver(spark):
    rng = np.random.default_rng(8)
    at = rng.integers(0, 100_000, 5000)
    events = spark.createDataFrame([(0, "uhf", int(t)) for t in at] + [(0, "uhf", None), (None, "uhf", 5)], "run_id int, receiver_id string, t_us long").repartition(5)
    edges = [(k, 10 * k, None if k % 400 == 0 else 10 * k + 9) for k in range(10_000)] + [(10_000, 50, 40), (10_001, None, 40)]
    windows = spark.createDataFrame([(i, 0, "uhf", a, b) for i, a, b in edges], "id int, run_id int, receiver_id string, t_start_us long, t_end_us long").repartition(3)
    got = {r.id: r.events for r in views.coverage_by_time(windows, events).collect()}
    sorted_ = np.sort(at)
    for i, a, b in edges:
        want = 0 if a is None else max(0, int(np.searchsorted(sorted_, 2**62 if b is None else b, "right") - np.searchsorted(sorted_, a)))
        assert got[i] == want


def test_budget_over_equal_parts(spark):
    df = spark.range(5000).withColumn("size", F.col("id") % 7)
    used = np.cumsum([k % 7 for k in range(5000)])
    assert views.running_budget(df, "id", "size", 9000).count() == int((used <= 9000).sum())


def test_levels_at_the_limit_are_flagged_as_in_sql(spark, tmp_path):
    """The last level is 6 above the baseline but for the last bit of it."""
    cases = [(62, 12, 5.39, 5.44, 11.4), (62, 12, 41.5, 41.8, 47.56), (64, 12, 14.27, 14.67, 20.51), (63, 12, 57.37, 57.72, 63.51), (65, 12, 24.95, 25.05, 31.03), (300, 59, 10.2, 10.2, 16.2)]
    levels = [[lo] * (k + 1) + [hi] * (n - k - 2) + [last] for n, k, lo, hi, last in cases]
    rows = [(1000 * user + 7 * at + 1, 1000 * at, user, v) for user, vs in enumerate(levels) for at, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id long, us long, user_id long, value double").selectExpr("event_id", "timestamp_micros(us) AS ts", "user_id", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["overload_flags"]).fetchall())
    assert sorted(map(tuple, QUERIES["overload_flags"](spark, str(tmp_path)).select("event_id", "baseline", "overload").collect())) == want
    flags = {i: o for i, _, o in want}
    for user, vs in enumerate(levels):
        monitor = Monitor()
        got = [monitor.flag(v, 0.0)[1] for v in vs][-1]
        last = 1000 * user + 7 * (len(vs) - 1) + 1
        assert last % 50 == 0 or got == flags[last]
    inf = float("inf")
    assert detect.percentile_of([1.0, inf], 0.5) == inf and detect.percentile_of([-inf, 1.0], 0.5) == -inf and str(detect.percentile_of([-inf, inf], 0.5)) == "nan"
