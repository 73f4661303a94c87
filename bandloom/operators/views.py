"""Reports over events, channels, pairs and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import PART, PLACE, Ordered


def tone_text() -> Column:
    """How a tone reads: CTCSS 141.3, DCS 023N, DCS?, no tone, ?"""
    return (
        F.when(F.col("ctcss_hz").isNotNull(), F.format_string("CTCSS %.1f", "ctcss_hz"))
        .when(F.col("dcs_code").isNotNull(), F.concat(F.format_string("DCS %03d", "dcs_code"), F.coalesce("dcs_polarity", F.lit(""))))
        .when(F.col("tone_state") == "dcs", "DCS?").when(F.col("tone_state") == "none", "no tone").otherwise("?")
    )


def mhz_text(hz: str, places: int = 4) -> Column:
    """A frequency as MHz with so many decimals, halves up, worked out in whole numbers."""
    unit = 10 ** (6 - places)
    steps = F.expr(f"({hz} + {unit // 2}) div {unit}")
    return F.format_string(f"%d.%0{places}d", F.floor(steps / 10**places).cast("long"), steps % 10**places)


def when_text(us: str) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def events_view(events: DataFrame, channels: DataFrame, plan: DataFrame) -> DataFrame:
    """Events in order of time with tone, state and the channel's or the plan's label. ``events``: with key and band_plan_id."""
    named = events.join(channels.select("key", F.col("label").alias("_c")), "key", "left").join(plan.select(F.col("id").alias("band_plan_id"), F.col("label").alias("_p")), "band_plan_id", "left")
    return named.select(
        "id", when_text("t_us").alias("at"), "freq_hz", mhz_text("freq_hz").alias("mhz"), F.when(F.col("duration_s").isNull(), "open").otherwise("closed").alias("state"), tone_text().alias("tone"), "snr_db", "deviation_hz",
        F.when(F.col("overload") == 1, "OVL").alias("ovl"), F.coalesce("_c", "_p").alias("label"), "t_us",
    ).orderBy("t_us", "id")


def activity(events: DataFrame) -> DataFrame:
    out = events.groupBy("freq_hz").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("duration_s").isNull()).alias("open"), F.round(F.sum("duration_s"), 4).alias("airtime_s"), F.round(F.avg("snr_db"), 4).alias("snr_db"),
        F.round(F.avg("deviation_hz"), 4).alias("deviation_hz"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
    )
    return out.orderBy(F.desc_nulls_last("airtime_s"), "freq_hz")


def contactable(scored: DataFrame) -> DataFrame:
    """Channels with a tier, the most usable first, with the input where one was observed."""
    inp = scored.select(F.col("freq_hz").alias("input_hz"), F.col("label").alias("input_label"))
    out = scored.where("tier IS NOT NULL").join(inp, "input_hz", "left")
    return out.select("freq_hz", "service", "label", "tier", tone_text().alias("tone"), "input_hz", "input_label", F.round("total_airtime_s", 4).alias("airtime_s"), "event_count").orderBy(F.desc("tier"), F.desc("airtime_s"), "freq_hz")


def coverage(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Per run, receiver and center: the first window's label or the center, windows, seconds listened (an open window counts none) and events heard in them."""
    heard = events.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    each = windows.join(heard, windows["id"] == heard["window_id"], "left")
    return each.groupBy("run_id", "receiver_id", "center_hz").agg(
        F.coalesce(F.min_by("label", "id"), F.concat(mhz_text("center_hz", 3), F.lit(" MHz"))).alias("label"), F.count_distinct("id").alias("windows"), F.sum(F.coalesce("t_end_us", "t_start_us") - F.col("t_start_us")).alias("listened_us"), F.sum(F.coalesce("n", F.lit(0))).alias("events"),
    ).orderBy("receiver_id", "center_hz", "run_id")


def coverage_by_time(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Events by the windows of their run and receiver that hold their start; an open window has no end.

    A sweep: events and the windows' edges are put in one order of time, the start of a window before
    the events of its instant and the end after them, and events are counted along it. A window has the
    count at its end less the one at its start, whatever its length and however many overlap.
    """
    by = ["run_id", "receiver_id"]
    none = F.lit(None).cast(windows.schema["id"].dataType).alias("id")
    e = events.where("t_us IS NOT NULL").groupBy(*by, F.col("t_us").alias("at")).agg(F.count(F.lit(1)).alias("n")).select(*by, "at", F.lit(1).alias("kind"), "n", none)
    edges = [(F.col("t_start_us"), 0), (F.coalesce("t_end_us", F.lit(2**63 - 1)), 2)]
    w = windows.where("t_start_us IS NOT NULL")
    marks = [w.select(*by, at.alias("at"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n"), "id") for at, kind in edges]
    o = Ordered(e.unionByName(marks[0]).unionByName(marks[1]), by, ["at", "kind"])
    upto = o.running(o.rows, {"upto": F.col("n")}).where("kind <> 1")
    met = upto.groupBy("id").agg(F.sum((F.col("kind") - 1) * F.col("upto")).alias("n"))
    return windows.select("id").join(met, "id", "left").select("id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("events"))


def in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Every event with the center and label of the window it was heard in, if that is known."""
    w = windows.select(F.col("id").alias("window_id"), "center_hz", F.col("label").alias("window_label"))
    return events.join(w, "window_id", "left")


def run_statistics(events: DataFrame) -> DataFrame:
    """Per run: events, those still open, hours between first and last start, and events an hour."""
    hours = (F.max("t_us") - F.min("t_us")) / F.lit(3.6e9)
    out = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("duration_s").isNull()).alias("open"), hours.alias("hours"))
    return out.select("run_id", "events", "open", F.round("hours", 4).alias("hours"), F.when(F.col("hours") > 0, F.round(F.col("events") / F.col("hours"), 4)).alias("per_hour"))


def busiest(events: DataFrame, n: int = 25) -> DataFrame:
    out = events.groupBy("freq_hz").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("snr_db"), 1).alias("snr_db"), F.min_by("ctcss_hz", "id").alias("ctcss_hz"), F.count_if(F.col("tone_state") == "dcs").alias("dcs"))
    return out.orderBy(F.desc("hits"), "freq_hz").limit(n)


def latest(events: DataFrame, n: int = 15) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(n)


def totals(events: DataFrame, version: DataFrame) -> DataFrame:
    """Rows, overloads and rows without an end, with the schema's version as a scalar."""
    return events.agg(F.count(F.lit(1)).alias("events"), F.sum("overload").alias("overloads"), F.count_if(F.col("duration_s").isNull()).alias("open")).join(version.agg(F.max("version").alias("version")))


def concatenated(parents: DataFrame, children: DataFrame, key: str, text: Column, order: str, sep: str = " ") -> DataFrame:
    """Each parent with its children's texts in order, or null."""
    joined = children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("_t")))), lambda x: x["_t"]), sep).alias("items"))
    return parents.join(joined, key, "left")


def histogram(events: DataFrame, bin_hz: int = 12_500) -> DataFrame:
    return events.groupBy(F.expr(f"freq_hz div {bin_hz} * {bin_hz}").alias("bin_hz")).agg(F.count(F.lit(1)).alias("n"))


def ppm(events: DataFrame, nominal_hz: int) -> DataFrame:
    e = events.where((F.col("freq_hz") == nominal_hz) & F.col("freq_raw_hz").isNotNull())
    return e.agg(F.round(F.avg(F.col("freq_raw_hz") - F.col("freq_hz")), 4).alias("error_hz"), F.round(F.avg(F.col("freq_raw_hz") - F.col("freq_hz")) / (nominal_hz / 1e6), 4).alias("ppm"))


def peaks(power: DataFrame, by: str, value: str, least: float, n: int = 25) -> DataFrame:
    return power.where(F.col(value) >= least).orderBy(F.desc(value), by).limit(n)


def running_budget(files: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """Files in order while the sum of sizes stays within the budget; once stopped, stopped."""
    o = Ordered(files, [], [order])
    return o.running(o.rows, {"used": F.col(size)}).where(F.col("used") <= budget).drop(PART, PLACE)
