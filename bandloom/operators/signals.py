"""What an event's signal says: deviation, tone, code. Samples are measured by one Arrow function; every decision is columns and groups.

A code is found by counting: the words read at every place of a signal become rows, in both polarities,
each is decoded by itself, and readings are grouped by where in the word they began. Two tables meet: the codes that
repeats agree on, and the majority of their bits, decoded again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp, golay
from ..session import small_batches, stored

#: Seconds that tones and codes need, the shares of power and the strengths (Hz) that decide.
TONE_DWELL_S, CODE_DWELL_S = 0.7, 0.55
TONE_SHARE, TONE_HZ, CODE_SHARE, CODE_RMS_HZ = 0.5, 100.0, 0.30, 150.0
FULL = (1 << dsp.WORD) - 1


def readings(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, polarity, turn, at, word): each word of ``words`` (key, words: the 23 bits from each place on), and its complement."""
    placed = words.select(*key, F.posexplode("words").alias("at", "_w"))
    pair = [F.struct(F.lit(p).alias("polarity"), w.cast("long").alias("word")) for p, w in (("N", F.col("_w")), ("I", F.lit(FULL) - F.col("_w")))]
    both = F.explode(F.array(*pair))
    return placed.select(*key, (F.col("at") % dsp.WORD).alias("turn"), "at", both.alias("_r")).select(*key, "turn", "at", "_r.*")


def codes(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, code, polarity, errors, agree) of the signals that repeat one code.

    At a turn of the word and a polarity, two readings must agree, and the majority of all readings' bits must decode
    to the same code. A signal reads as one normal code, and inverted as that code's partner or not at all; anything else is noise.
    """
    by = [*key, "polarity", "turn"]
    each = readings(words, key)
    agreed = golay.decoded(each).where("code IS NOT NULL").groupBy(*by, "code").agg(F.count(F.lit(1)).alias("agree"), F.min("at").alias("first"))
    top = agreed.groupBy(*by).agg(F.max(F.struct("agree", (-F.col("first")).alias("f"), F.col("code").alias("said"))).alias("t")).select(*by, "t.agree", "t.said")
    ones = [F.sum(F.getbit("word", F.lit(j)).cast("long")).alias(f"b{j}") for j in range(dsp.WORD)]
    sums = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *ones).where(F.col("n") >= dsp.REPEATS)
    most = reduce(Column.__add__, [F.when(2 * F.col(f"b{j}") > F.col("n"), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")) for j in range(dsp.WORD)])
    found = golay.decoded(sums.select(*by, most.alias("word"))).join(top, by).where((F.col("code") == F.col("said")) & (F.col("agree") >= dsp.REPEATS))
    normal, inverted = (F.collect_set(F.when(F.col("polarity") == p, F.col("code"))).alias(p) for p in "NI")  # 23 turns at most
    best = F.max(F.when(F.col("polarity") == "N", F.struct("agree", (-F.col("errors")).alias("e")))).alias("best")
    one = found.groupBy(*key).agg(normal, inverted, best).where(F.size("N") == 1).withColumn("code", F.col("N")[0])
    pairs = F.broadcast(golay.inverse_pairs(words.sparkSession))  # a row for each code
    good = one.join(pairs, "code").where(F.size(F.array_except("I", F.array("reads_as"))) == 0)
    return good.select(*key, "code", F.lit("N").alias("polarity"), (-F.col("best.e")).cast("int").alias("errors"), F.col("best.agree").alias("agree"))


def decided(m: DataFrame, key: list[str]) -> DataFrame:
    """Stored measurements (key, and the fields of ``dsp.MEASURED``) with what they say of tone and code.

    Below the dwell nothing is said; a tone needs most of the power below the voice; a code is looked for where no tone
    stands out and there is power. A code is its three octal digits read as a number, as the events table has it.
    """
    checked = F.coalesce(F.col("dwell_s") >= TONE_DWELL_S, F.lit(False))
    share = F.when(F.col("rms_hz") > 0, F.least(F.lit(1.0), F.pow(F.col("tone_dev_hz") / F.col("rms_hz"), 2) / 2)).otherwise(0.0)
    toned = checked & (F.col("_share") >= TONE_SHARE) & (F.col("tone_dev_hz") >= TONE_HZ)
    maybe = checked & ~toned & (F.col("_share") < CODE_SHARE) & (F.col("rms_hz") >= CODE_RMS_HZ)
    rows = m.withColumn("_share", share).withColumn("_maybe", maybe)
    read = codes(rows.where("_maybe AND words IS NOT NULL").where(F.col("dwell_s") >= CODE_DWELL_S).select(*key, "words"), key)
    out = rows.join(read, key, "left")
    known = F.col("deviation_hz").isNotNull()
    return out.select(
        *key, "deviation_hz", "freq_error_hz", "analyzed_s", F.when(toned, F.col("tone_hz")).alias("ctcss_hz"), F.when(known, F.when(checked, F.col("_share")).otherwise(0.0)).alias("ctcss_conf"),
        F.when(known, F.when(checked, F.col("tone_dev_hz")).otherwise(0.0)).alias("ctcss_dev_hz"), F.col("code").cast("int").alias("dcs_code"), F.col("polarity").alias("dcs_polarity"),
        F.col("errors").alias("dcs_errors"), F.when(known, F.col("_maybe")).alias("dcs_suspected"), F.when(known, checked).alias("tone_checked"),
    )


def analysed(samples: DataFrame, key: list[str]) -> DataFrame:
    """Results of events (key, i, q, rate, offset), a row for each key: samples are read once and go no further than their row.

    Bytes of complex floats, iq, may stand for i and q; Spark hands these on whole, where it takes arrays number by number.
    """
    small_batches(samples.sparkSession)
    parts = ["iq"] if "iq" in samples.columns else ["i", "q"]
    m = samples.select(*key, dsp.measure(parts, "rate", "offset").alias("m")).select(*key, "m.*")
    return decided(stored(m, "measured"), key)


def tone_state() -> Column:
    """How a result reads: dcs, ctcss, none or unknown."""
    return F.when(F.col("dcs_code").isNotNull(), "dcs").when(F.col("ctcss_hz").isNotNull(), "ctcss").when(F.col("dcs_suspected"), "dcs").when(F.col("tone_checked"), "none").otherwise("unknown")
