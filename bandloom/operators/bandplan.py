"""Frequencies against ranges: containment joins, ties, gaps, windows and audits.

A range join here is an equi join on a bucket of the spectrum with the exact test as residual:
a frequency has one bucket and a range is listed under each bucket it touches, so neither side
needs to be broadcast and no pair is made twice. Spark still broadcasts the plan when it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HZ = 100_000
BIN_HZ = 6_250


def width() -> Column:
    return F.col("freq_hi_hz") - F.col("freq_lo_hz")


def offset() -> Column:
    """Distance to the nominal center, or to the middle (whole Hz) of a range without one."""
    return F.abs(F.coalesce(F.col("freq_center_hz"), F.expr("(freq_lo_hz + freq_hi_hz) div 2")) - F.col("freq_hz"))


def contained(freqs: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``freqs`` (freq_hz, ...) with every range of ``plan`` that holds freq_hz."""
    listed = plan.withColumn("_bucket", F.explode(F.expr(f"sequence(freq_lo_hz div {BUCKET_HZ}, freq_hi_hz div {BUCKET_HZ})")))
    at = F.expr(f"freq_hz div {BUCKET_HZ}") == F.col("_bucket")
    return freqs.join(listed, at & F.col("freq_hz").between(F.col("freq_lo_hz"), F.col("freq_hi_hz")), how).drop("_bucket")


def lookup(freqs: DataFrame, plan: DataFrame) -> DataFrame:
    """All matches of each distinct frequency, with width_hz, offset_hz and their place, narrowest first."""
    found = contained(freqs.select("freq_hz").distinct(), plan).withColumns({"width_hz": width(), "offset_hz": offset()})
    order = Window.partitionBy("freq_hz").orderBy("width_hz", "offset_hz", "licensed", "service", "id")
    return found.withColumn("place", F.row_number().over(order))


def best(freqs: DataFrame, plan: DataFrame) -> DataFrame:
    """The narrowest match of each distinct frequency."""
    return lookup(freqs, plan).where("place = 1")


def tied(freqs: DataFrame, plan: DataFrame) -> DataFrame:
    """(freq_hz, width_hz, tied): matches as narrow as the narrowest, in order."""
    found = lookup(freqs, plan)
    least = Window.partitionBy("freq_hz").orderBy("width_hz")
    row = F.struct("place", "id", "label", "service", "kind", "freq_center_hz", "bandwidth_hz", "licensed", "is_repeater_out")
    top = found.withColumn("_r", F.rank().over(least)).where("_r = 1")
    return top.groupBy("freq_hz").agg(F.min("width_hz").alias("width_hz"), F.array_sort(F.collect_list(row)).alias("tied"))


def unallocated(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Distinct frequencies that no range holds."""
    return contained(events.select("freq_hz").distinct(), plan, "left_anti")


def tag(events: DataFrame, plan: DataFrame, retag: bool = False) -> DataFrame:
    """Events with band_plan_id: all of them, or only those that have none yet."""
    named = best(events, plan).select("freq_hz", F.col("id").alias("_best"))
    old = F.col("band_plan_id") if "band_plan_id" in events.columns and not retag else F.lit(None).cast("long")
    return events.join(named, "freq_hz", "left").withColumn("band_plan_id", F.coalesce(old, "_best")).drop("_best")


def bin_of(freq: Column) -> Column:
    """The nearest bin, halves to the even one."""
    return (F.rint(freq / F.lit(float(BIN_HZ))) * BIN_HZ).cast("long")


def places(freqs: DataFrame, plan: DataFrame) -> DataFrame:
    """(freq_hz, key, width_hz, tied) of each distinct frequency, from one lookup: :func:`channel_key` with :func:`tied`, null where no range holds it."""
    row = F.struct("place", "id", "label", "service", "kind", "freq_center_hz", "bandwidth_hz", "licensed", "is_repeater_out")
    found = lookup(freqs, plan).withColumn("_r", F.rank().over(Window.partitionBy("freq_hz").orderBy("width_hz"))).where("_r = 1")
    top = found.groupBy("freq_hz").agg(F.min("width_hz").alias("width_hz"), F.array_sort(F.collect_list(row)).alias("tied"))
    each = freqs.select("freq_hz").distinct().join(top, "freq_hz", "left")
    first = F.col("tied")[0]
    key = F.when(first["kind"] == "channel", first["freq_center_hz"]).otherwise(bin_of(F.col("freq_hz")))
    return each.select("freq_hz", key.alias("key"), "width_hz", "tied")


def channel_key(freqs: DataFrame, plan: DataFrame) -> DataFrame:
    """(freq_hz, key): the nominal center where the best match is a channel, else the bin."""
    top = best(freqs, plan).select("freq_hz", "kind", "freq_center_hz")
    each = freqs.select("freq_hz").distinct().join(top, "freq_hz", "left")
    return each.select("freq_hz", F.when(F.col("kind") == "channel", F.col("freq_center_hz")).otherwise(bin_of(F.col("freq_hz"))).alias("key"))


def duplicate_centers(centers: DataFrame) -> DataFrame:
    """(service, center, n): centers that a service has more than once, and that have no window for that reason."""
    return centers.groupBy("service", "center").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def nominal_windows(centers: DataFrame) -> DataFrame:
    """(service, center, bandwidth) with lo and hi: half the bandwidth or half the way to the nearest neighbour, hi a Hz short.

    A service that has a center twice is refused when the rows are worked out.
    """
    by = Window.partitionBy("service").orderBy("center")
    gap = F.least(F.col("center") - F.lag("center").over(by), F.lead("center").over(by) - F.col("center"))
    twice = F.raise_error(F.concat("service", F.lit(" has a center twice: "), F.col("center").cast("string"))).cast("long")
    half = F.when(F.col("_gap") == 0, twice).otherwise(F.least(F.expr("bandwidth div 2"), F.coalesce(F.expr("_gap div 2"), F.expr("bandwidth div 2"))))
    return centers.withColumn("_gap", gap).withColumn("_half", half).select("service", "center", "bandwidth", (F.col("center") - F.col("_half")).alias("lo"), (F.col("center") + F.col("_half") - 1).alias("hi"))


def listed(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(begun, held) by service, size and bucket: where ranges begin, and which ranges touch that bucket.

    A range is listed under at most five buckets of a size that follows its width, so a beginning meets few ranges that
    don't hold it, however dense the plan is. Each beginning is listed once for each size of bucket that there is.
    """
    size = F.greatest(F.length(F.bin(width())) - 2, F.lit(0))
    each = plan.select("service", "id", "freq_lo_hz", "freq_hi_hz")
    sized = each.where("freq_lo_hz <= freq_hi_hz").withColumn("size", size)  # a range that ends before it begins holds nothing
    cells = sized.withColumn("bucket", F.explode(F.expr("sequence(shiftright(freq_lo_hz, size), shiftright(freq_hi_hz, size))")))
    held = cells.select("service", "size", "bucket", F.col("id").alias("x"), F.col("freq_lo_hz").alias("xlo"), F.col("freq_hi_hz").alias("xhi"))
    sizes = sized.agg(F.collect_set("size").alias("sizes"))  # one row, 62 sizes at most
    begun = each.join(sizes).select("service", F.explode("sizes").alias("size"), F.col("id").alias("y"), F.col("freq_lo_hz").alias("ylo"), F.col("freq_hi_hz").alias("yhi"))
    return begun.withColumn("bucket", F.expr("shiftright(ylo, size)")), held


def overlaps(plan: DataFrame) -> DataFrame:
    """Pairs of one service whose ranges overlap: where the later one of them begins, the earlier one goes on."""
    by = ["service", "size", "bucket"]
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are many more than ranges, whose bytes would make few parts
    begun, held = (side.repartition(parts, *by) for side in listed(plan))
    met = begun.join(held, by).where("ylo <= xhi AND xlo <= yhi AND (xlo < ylo OR xlo = ylo AND x < y) AND x <> y")
    return met.select("service", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("service", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("freq_lo_hz").alias("lo"), F.max("freq_hi_hz").alias("hi")).orderBy("lo")


def described(freqs: DataFrame, plan: DataFrame) -> DataFrame:
    """One line for each frequency: its narrowest label, how far off its center it is, and the widest range around it."""
    each = lookup(freqs, plan).groupBy("freq_hz").agg(
        F.min_by("label", "place").alias("label"), F.min_by(F.col("freq_hz") - F.col("freq_center_hz"), F.col("place")).alias("off"), F.max_by("label", "place").alias("around"), F.max("place").alias("n"),
    )
    shift = F.when(F.col("off").isNotNull() & (F.col("off") != 0), F.format_string(" (%+.2f kHz)", F.col("off") / 1000)).otherwise("")
    inside = F.when(F.col("n") > 1, F.concat(F.lit(" in "), "around")).otherwise("")
    all_ = freqs.select("freq_hz").distinct().join(each, "freq_hz", "left")
    return all_.select("freq_hz", F.coalesce(F.concat("label", shift, inside), F.lit("unallocated")).alias("text"))
