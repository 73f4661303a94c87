"""From tagged events to channels, repeater pairs and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import bandplan
from .ordered import Ordered, medians

#: Evidence gates and limits.
MIN_SNR_DB = 18.0
LIMIT_HZ = {12_500: 2_500, 20_000: 5_000, 25_000: 5_000}
MARGIN_HZ = 1_500
MIN_MEASURED = 3
AGREEMENT = 0.8
MAX_LAG_US = 1_000_000
MIN_EVIDENCE = 3
MIN_CONFIDENCE = 0.5


def votes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value, c, total): each column's most common non-null value, ties to the smallest text.

    All columns in one pass: values become (name, text) rows and are counted before they meet.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(key, each.alias("v")).where("v.value IS NOT NULL").groupBy(key, "v.name", "v.value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(key, "name").agg(F.min_by("value", F.struct(-F.col("c"), "value")).alias("value"), F.max("c").alias("c"), F.sum("c").alias("total"))


def modal(df: DataFrame, key: str, column: str) -> DataFrame:
    return votes(df, key, [column]).select(key, F.col("value").alias(column), F.col("c").alias("agreeing"), F.col("total"))


def usable(min_snr: float = MIN_SNR_DB) -> Column:
    """The deviation where it was measured above the gate, else null."""
    return F.when(F.col("snr_db") >= min_snr, F.col("deviation_hz"))


def narrowed(tied: Column, median: Column, measured: Column) -> Column:
    """Candidates whose limit the measured deviation does not exceed; all, if evidence is thin, limits are alike or none would stay."""
    limits = F.create_map(*[F.lit(x) for pair in LIMIT_HZ.items() for x in pair])

    def limit(t: Column) -> Column:
        return F.try_element_at(limits, t["bandwidth_hz"].cast("int"))

    distinct = F.size(F.array_distinct(F.filter(F.transform(tied, limit), lambda x: x.isNotNull())))
    keep = F.filter(tied, lambda t: limit(t).isNull() | (median <= limit(t) + MARGIN_HZ))
    return F.when((measured >= MIN_MEASURED) & (distinct >= 2) & (F.size(keep) > 0), keep).otherwise(tied)


def keyed(events: DataFrame, plan: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Events with their channel's key; ``places``: as :func:`bandplan.places` gives them, if they are there already."""
    return events.join((bandplan.channel_key(events, plan) if places is None else places).select("freq_hz", "key"), "freq_hz")


def bucket_plans(events: DataFrame, plan: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(key, tied): the narrowest list of tied ranges that any frequency of the key has; of equal ones that of the lowest frequency."""
    each = (bandplan.places(events, plan) if places is None else places).where("tied IS NOT NULL")
    return each.groupBy("key").agg(F.min_by("tied", F.struct("width_hz", "freq_hz")).alias("tied"))


def tone_decision(v: DataFrame, key: str, agreement: float = AGREEMENT) -> DataFrame:
    """(key, tone_state, ctcss_hz, dcs_code, dcs_polarity) from :func:`votes` over 'state', ctcss_hz, dcs_code, dcs_polarity."""

    def of(name: str, what: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(what)))

    w = v.groupBy(key).agg(*[of(n, x).alias(f"{n}_{x}") for n in ("state", "ctcss_hz", "dcs_code", "dcs_polarity") for x in ("value", "c", "total")])

    def firm(n: str) -> Column:
        return F.col(f"{n}_c") / F.col(f"{n}_total") >= F.lit(float(agreement))

    state = F.when(F.col("state_value").isNull() | ~firm("state"), "unknown").when((F.col("state_value") == "ctcss") & ~F.coalesce(firm("ctcss_hz"), F.lit(False)), "unknown").when((F.col("state_value") == "dcs") & ~F.coalesce(firm("dcs_code"), F.lit(True)), "unknown").otherwise(F.col("state_value"))
    w = w.withColumn("tone_state", state)
    return w.select(
        key, "tone_state", F.when(F.col("tone_state") == "ctcss", F.col("ctcss_hz_value")).cast("double").alias("ctcss_hz"),
        F.when(F.col("tone_state") == "dcs", F.col("dcs_code_value")).cast("int").alias("dcs_code"), F.when(F.col("tone_state") == "dcs", F.col("dcs_polarity_value")).alias("dcs_polarity"),
    )


def rollup(events: DataFrame, plan: DataFrame, notes: DataFrame | None = None, agreement: float = AGREEMENT, places: DataFrame | None = None) -> DataFrame:
    """One channel for each key, with ids by frequency; ``notes`` (freq_hz, notes) are kept by reported frequency.

    Frequencies are looked up once: ``places`` are stored, or given.
    """
    places = stored(bandplan.places(events, plan), "places") if places is None else places
    e = keyed(events, plan, places)
    measured = usable()
    sums = e.groupBy("key").agg(
        F.count(F.lit(1)).alias("event_count"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_airtime_s"), F.min("t_us").alias("first_seen_us"), F.max("t_us").alias("last_seen_us"),
        F.count(measured).alias("_measured"),
    )
    sums = sums.join(medians(e, ["key"], {"_median": measured, "_freq": F.col("freq_hz")}), "key")
    state = F.when(F.col("tone_state") != "unknown", F.col("tone_state"))
    content = ["content"] if "content" in events.columns else []
    v = votes(e.withColumn("state", state), "key", ["state", "ctcss_hz", "dcs_code", "dcs_polarity", "modulation", *content])
    tone = tone_decision(v, "key", agreement)
    kind = v.groupBy("key").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in ("modulation", "content")])
    all_ = sums.join(bucket_plans(e, plan, places), "key", "left").join(tone, "key", "left").join(kind, "key", "left")
    tied = narrowed(F.coalesce("tied", F.array().cast(all_.schema["tied"].dataType)), F.col("_median"), F.col("_measured"))
    all_ = all_.withColumn("_tied", tied).withColumn("_plan", F.when(F.size("_tied") > 0, F.col("_tied")[0]))
    freq = F.when(F.col("_plan.kind") == "channel", F.col("_plan.freq_center_hz")).otherwise(F.floor("_freq").cast("long"))
    label = F.array_join(F.array_distinct(F.transform("_tied", lambda t: t["label"])), " / ")
    out = all_.select(
        "key", freq.alias("freq_hz"), F.col("_plan.service").alias("service"), F.when(label != "", label).alias("label"), F.col("_plan.id").alias("band_plan_id"), "modulation", "content",
        F.coalesce("tone_state", F.lit("unknown")).alias("tone_state"), "ctcss_hz", "dcs_code", "dcs_polarity", "first_seen_us", "last_seen_us", "event_count", "total_airtime_s", F.bround("_median", 1).alias("deviation_hz"),
        F.col("_plan.licensed").alias("licensed"), F.col("_plan.is_repeater_out").alias("is_repeater_out"),
    )
    return out if notes is None else out.join(notes, "freq_hz", "left")


def pair_candidates(channels: DataFrame, plan: DataFrame) -> DataFrame:
    """(output_hz, input_hz, offset_hz): channels whose frequency plus a distinct offset of the plan is another channel's."""
    offsets = plan.where("pair_offset_hz IS NOT NULL").select(F.col("pair_offset_hz").alias("offset_hz")).distinct().agg(F.collect_list("offset_hz").alias("all"))
    one = channels.select(F.col("freq_hz").alias("output_hz")).join(offsets)  # the offsets are one row
    wanted = one.select("output_hz", F.explode("all").alias("offset_hz")).withColumn("input_hz", F.col("output_hz") + F.col("offset_hz"))
    return wanted.join(channels.select(F.col("freq_hz").alias("input_hz")), "input_hz").select("output_hz", "input_hz", "offset_hz")


def pair_nearest(events: DataFrame, pairs: DataFrame, max_lag_us: int = MAX_LAG_US) -> DataFrame:
    """For each event of a pair's output the nearest event of its input within the lag, before or after.

    ``events``: (id, t_us, channel_hz). A channel's inputs and the outputs paired with it stand in one order of time, and an
    output sees the last input up to it and the first one after it, however many are within the lag; ties go to the
    earliest input, then to the smallest id. lag_us is output minus input.
    """
    pairs, events = pairs.select("output_hz", "input_hz").distinct(), events.where("t_us IS NOT NULL")
    out = events.join(pairs, events["channel_hz"] == pairs["output_hz"]).select("input_hz", "t_us", F.lit(1).alias("late"), F.lit(None).cast("struct<in_us: bigint, in_id: bigint>").alias("heard"), "output_hz", F.col("id").alias("out_id"))
    inp = events.join(pairs.select("input_hz").distinct(), events["channel_hz"] == F.col("input_hz"), "left_semi").groupBy(F.col("channel_hz").alias("input_hz"), "t_us").agg(F.min("id").alias("in_id"))
    inp = inp.select("input_hz", "t_us", F.lit(0).alias("late"), F.struct(F.col("t_us").alias("in_us"), "in_id").alias("heard"), F.lit(None).cast("long").alias("output_hz"), F.lit(None).cast("long").alias("out_id"))
    o = Ordered(inp.unionByName(out), ["input_hz"], ["t_us", "late"])
    rows = o.upcoming(o.latest(o.rows, "_last", F.col("heard"), F.lit(None)).drop("_last_before"), "_next", F.col("heard")).where("late = 1")
    near = rows.select("output_hz", "input_hz", "out_id", F.explode(F.array("_last", "_next")).alias("m"), "t_us").where("m IS NOT NULL").withColumn("lag_us", F.col("t_us") - F.col("m.in_us")).where(F.abs("lag_us") <= max_lag_us)
    near = near.groupBy("output_hz", "input_hz", "out_id").agg(F.min_by(F.struct("m.in_id", "lag_us"), F.struct(F.abs("lag_us"), "m.in_us", "m.in_id")).alias("m"))
    return near.select("output_hz", "input_hz", "out_id", "m.in_id", "m.lag_us")


def pair_evidence(events: DataFrame, pairs: DataFrame, max_lag_us: int = MAX_LAG_US, min_evidence: int = MIN_EVIDENCE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(output_hz, input_hz, evidence_count, median_lag_us, confidence) of the pairs that enough keyups bear out."""
    outs = events.groupBy(F.col("channel_hz").alias("output_hz")).agg(F.count(F.lit(1)).alias("outputs")).where(F.col("outputs") >= min_evidence)
    near = stored(pair_nearest(events, pairs, max_lag_us).select("output_hz", "input_hz", "lag_us"), "keyups")
    met = near.groupBy("output_hz", "input_hz").agg(F.count(F.lit(1)).alias("evidence_count")).join(medians(near, ["output_hz", "input_hz"], {"median_lag_us": F.col("lag_us")}), ["output_hz", "input_hz"])
    share = F.col("evidence_count") / F.col("outputs")
    return met.join(outs, "output_hz").where((F.col("evidence_count") >= min_evidence) & (share >= min_confidence)).select("output_hz", "input_hz", "evidence_count", "median_lag_us", F.bround(share, 3).alias("confidence"))


def tiers(channels: DataFrame, licences: tuple[str, ...] = ()) -> DataFrame:
    """Channels (deviation_hz, tone_state, ctcss_hz, dcs_code, is_repeater_out, paired, service, licensed) with ``tier`` 0 to 4."""
    c = F.col
    tone = (c("tone_state") == "none") | ((c("tone_state") == "ctcss") & c("ctcss_hz").isNotNull()) | ((c("tone_state") == "dcs") & c("dcs_code").isNotNull())
    repeater = (F.coalesce("is_repeater_out", F.lit(0)) == 0) | c("paired")
    may = c("service").isNotNull() & (F.coalesce(c("licensed") == 0, F.lit(False)) | c("service").isin(*licences))
    resolved = c("tone_state").isin("none", "ctcss", "dcs")
    tier = F.when(c("deviation_hz").isNull(), 0).when(~resolved, 1).when(~(tone & repeater), 2).when(~may, 3).otherwise(4)
    return channels.withColumn("tier", tier)


def tier_histogram(scored: DataFrame) -> DataFrame:
    spark = scored.sparkSession
    return spark.range(5).select(F.col("id").cast("int").alias("tier")).join(scored.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def placed(events: DataFrame, plan: DataFrame, agreement: float = AGREEMENT) -> tuple[DataFrame, DataFrame]:
    """(channels, events as (id, t_us, channel_hz)). Places and channels, a row for each frequency and channel, are stored; events are joined to them."""
    places = stored(bandplan.places(events, plan), "places")
    channels = stored(rollup(events, plan, agreement=agreement, places=places), "channels")
    at = places.join(channels.select("key", F.col("freq_hz").alias("channel_hz")), "key").select("freq_hz", "channel_hz")
    return channels, events.select("id", "t_us", "freq_hz").join(at, "freq_hz").select("id", "t_us", "channel_hz")


def stamped(df: DataFrame, name: str, at: float | None = None) -> DataFrame:
    """``df`` with the time (seconds since 1970) at which it was made, the same for all rows; ``at`` stands in for the clock."""
    return df.withColumn(name, F.unix_micros(F.current_timestamp()) / F.lit(1e6) if at is None else F.lit(float(at)))


def enriched(events: DataFrame, plan: DataFrame, licences: tuple[str, ...] = (), max_lag_us: int = MAX_LAG_US, at: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(channels with tiers and rebuilt_at, pairs with inferred_at): each pass stores what the next ones read more than once."""
    channels, located = placed(events, plan)
    pairs = stamped(stored(pair_evidence(located, pair_candidates(channels, plan), max_lag_us), "pairs"), "inferred_at", at)
    first = pairs.groupBy("output_hz").agg(F.min("input_hz").alias("input_hz"))
    joined = channels.join(first, channels["freq_hz"] == first["output_hz"], "left").withColumn("paired", F.col("input_hz").isNotNull()).drop("output_hz")
    return stamped(tiers(joined, licences), "rebuilt_at", at), pairs


def with_ids(channels: DataFrame) -> DataFrame:
    """Ids in order of frequency; channels are few (one for each channel or bin of the spectrum)."""
    return channels.withColumn("id", F.row_number().over(Window.orderBy("freq_hz")).cast("long"))


def with_pair_ids(channels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``channels`` (freq_hz, ...) with pair_id: the lowest id of the pairs whose output they are; ids go by output, then input."""
    numbered = pairs.select("output_hz", F.row_number().over(Window.orderBy("output_hz", "input_hz")).cast("long").alias("_id"))  # pairs are fewer than channels
    least = numbered.groupBy(F.col("output_hz").alias("freq_hz")).agg(F.min("_id").alias("pair_id"))
    return channels.join(least, "freq_hz", "left")


def pair_rows(channels: DataFrame, pairs: DataFrame, at: float | None = None) -> DataFrame:
    """Rows of the table of pairs: channels (id, freq_hz) named by id, the offset between them, the lag in seconds."""
    numbered = pairs.withColumn("id", F.row_number().over(Window.orderBy("output_hz", "input_hz")).cast("long"))  # pairs are fewer than channels
    named = [channels.select(F.col("freq_hz").alias(f"{side}_hz"), F.col("id").alias(f"{side}_channel_id")) for side in ("output", "input")]
    rows = numbered.join(named[0], "output_hz").join(named[1], "input_hz").withColumn("offset_hz", F.col("input_hz") - F.col("output_hz"))
    rows = rows.select("id", "output_channel_id", "input_channel_id", "offset_hz", "evidence_count", (F.col("median_lag_us") / 1e6).alias("median_lag_s"), "confidence")
    return stamped(rows, "inferred_at", at)


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
