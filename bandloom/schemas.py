"""Table schemas (version 8) and the constraints that Parquet does not hold, as checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 8

TABLES = {
    "events": "id long, run_id long not null, receiver_id string not null, t_start double not null, t_end double, duration_s double, freq_hz long not null, "
    "freq_raw_hz long, bandwidth_hz long, peak_dbfs double, noise_dbfs double, snr_db double, modulation string, content string, deviation_hz double, "
    "ctcss_hz double, ctcss_dev_hz double, dcs_code int, dcs_polarity string, tone_state string, confidence double, overload int not null, audio_path string, "
    "iq_path string, channel_id long, band_plan_id long, analyzed_s double, dcs_errors int, window_id long",
    "channels": "id long, freq_hz long not null, service string, label string, band_plan_id long, modulation string, content string, ctcss_hz double, dcs_code int, "
    "dcs_polarity string, first_seen double, last_seen double, event_count long not null, total_airtime_s double not null, tier int, pair_id long, "
    "rebuilt_at double, notes string, tone_state string, deviation_hz double",
    "pairs": "id long, output_channel_id long not null, input_channel_id long not null, offset_hz long not null, evidence_count long not null, median_lag_s double, "
    "confidence double, inferred_at double",
    "band_plan": "id long, freq_lo_hz long not null, freq_hi_hz long not null, freq_center_hz long, bandwidth_hz long, service string not null, label string not null, "
    "channel_number string, kind string not null, is_repeater_out int not null, pair_offset_hz long, licensed int not null, source string, notes string",
    "runs": "id long, started_at double not null, ended_at double, host string, git_commit string, profile_name string, profile_yaml string, notes string",
    "run_receivers": "id long, run_id long not null, receiver_id string not null, serial string, center_hz long, sample_rate_hz double, gain_db double",
    "coverage_windows": "id long, run_id long not null, receiver_id string not null, center_hz long not null, sample_rate_hz double, label string, t_start double not null, t_end double",
    "decodes": "id long, event_id long not null, decoder string, payload string, decoded_at double",
    "schema_meta": "key string, value string",
}


def within(c: str, *values) -> Column:
    return F.col(c).isNull() | F.col(c).isin(*values)


#: name -> what a good row satisfies; a null result counts as good
CHECKS: dict[str, dict[str, Column]] = {}


def checks(table: str) -> dict[str, Column]:
    c = F.col
    return {
        "events": {
            "end_after_start": c("t_end") >= c("t_start"), "duration_not_negative": c("duration_s") >= 0, "one_tone_kind": ~(c("ctcss_hz").isNotNull() & c("dcs_code").isNotNull()),
            "polarity": within("dcs_polarity", "N", "I"), "tone_state": within("tone_state", "none", "ctcss", "dcs", "unknown"), "confidence": c("confidence").between(0, 1), "overload": within("overload", 0, 1),
        },
        "channels": {"tier": c("tier").between(0, 4)},
        "band_plan": {
            "range": c("freq_hi_hz") > c("freq_lo_hz"), "center": c("freq_center_hz").between(c("freq_lo_hz"), c("freq_hi_hz")), "channel_has_center": (c("kind") != "channel") | c("freq_center_hz").isNotNull(),
            "kind": within("kind", "channel", "segment"), "flags": within("licensed", 0, 1) & within("is_repeater_out", 0, 1),
        },
    }.get(table, {})


UNIQUE = {"run_receivers": ("run_id", "receiver_id"), "channels": ("freq_hz",), "pairs": ("output_channel_id", "input_channel_id"), "band_plan": ("service", "label", "freq_lo_hz")}
#: child column -> (parent table, parent key)
FOREIGN = {"events": {"run_id": ("runs", "id"), "channel_id": ("channels", "id"), "band_plan_id": ("band_plan", "id"), "window_id": ("coverage_windows", "id")}, "decodes": {"event_id": ("events", "id")}, "run_receivers": {"run_id": ("runs", "id")}}


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def duplicates(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose reference names no row of ``parent``; null references none."""
    refs = parent.select(F.col(key).alias("_ref"))
    return child.where(F.col(column).isNotNull()).join(refs, F.col(column) == F.col("_ref"), "left_anti")


# ---------------------------------------------------------------- versions


def _add(**columns: str):
    return lambda df: df.withColumns({k: F.lit(None).cast(v) for k, v in columns.items() if k not in df.columns})


def _tone_state(df: DataFrame) -> DataFrame:
    known = F.when(F.col("ctcss_hz").isNotNull(), "ctcss").when(F.col("dcs_code").isNotNull(), "dcs").otherwise("unknown")
    return df if "tone_state" in df.columns else df.withColumn("tone_state", known)


#: table -> the version that brought it; the others were there from the first
SINCE = {"coverage_windows": 7}
#: view -> the version that brought it
VIEWS = {"v_contactable": 4, "v_events": 4, "v_activity": 5, "v_coverage": 7}


def tables_at(version: int) -> dict[str, str]:
    return {name: spec for name, spec in TABLES.items() if SINCE.get(name, 0) <= version}


#: version -> table -> how its rows get there from the version before
MIGRATIONS = {
    3: {"events": _tone_state, "channels": _tone_state},
    4: {},
    5: {"events": lambda df: df, "channels": _add(deviation_hz="double")},
    6: {"events": _add(analyzed_s="double", dcs_errors="int")},
    7: {},
    8: {"events": _add(window_id="long")},
}


def migrated(df: DataFrame, table: str, at: int, to: int = VERSION) -> DataFrame:
    """``df`` of version ``at`` with the columns of version ``to``; going down is refused."""
    if to < at:
        raise ValueError(f"table is at version {at}; {to} is older")
    steps = [MIGRATIONS[v][table] for v in range(at + 1, to + 1) if table in MIGRATIONS[v]]
    return reduce(lambda d, f: f(d), steps, df)
