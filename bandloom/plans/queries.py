"""Every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import golay, spectrum
from ..operators import bandplan, detect, enrich, excerpts, lifecycle, mutations, signals, views
from ..operators.ordered import medians
from ..session import stored
from ..sources import bridge, seed, stations
from ..sources.bridge import PLAN_SQL, SIG_SQL, WINDOWS_SQL, plan, sig, table, windows
from ..streaming import detector, excerpt, receiver

LICENCES = ("gmrs",)
LAG_US = 14_400_000_000  # the driver's events are hours apart
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


MATCH_SQL = f"""{SIG_SQL}, {PLAN_SQL}, f AS (SELECT DISTINCT freq_hz FROM sig), m AS (
  SELECT f.freq_hz, p.*, freq_hi_hz - freq_lo_hz AS width_hz, abs(coalesce(freq_center_hz, (freq_lo_hz + freq_hi_hz) // 2) - f.freq_hz) AS offset_hz
  FROM f JOIN plan p ON f.freq_hz BETWEEN freq_lo_hz AND freq_hi_hz), l AS (
  SELECT *, row_number() OVER (PARTITION BY freq_hz ORDER BY width_hz, offset_hz, licensed, service, id) AS place, rank() OVER (PARTITION BY freq_hz
      ORDER BY width_hz) AS r FROM m)"""
KEY_SQL = f"""{MATCH_SQL}, ck AS (SELECT f.freq_hz,
    CASE WHEN l.kind = 'channel' THEN l.freq_center_hz ELSE CAST(round_even(f.freq_hz / 6250.0::DOUBLE, 0) * 6250 AS BIGINT) END AS key
  FROM f LEFT JOIN l ON l.freq_hz = f.freq_hz AND place = 1)"""


def vote_sql(name: str, source: str, key: str, value: str) -> str:
    return f"""{name} AS (SELECT key, arg_min(value, (-c, value)) AS value, max(c) AS c, sum(c) AS total FROM (
      SELECT {key} AS key, CAST({value} AS VARCHAR) AS value, count(*) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL) GROUP BY key)"""


TONE_SQL = f"""{KEY_SQL}, ev AS (SELECT sig.*, key, CASE WHEN tone_state <> 'unknown' THEN tone_state END AS state FROM sig JOIN ck USING (freq_hz)),
{vote_sql("vs", "ev", "key", "state")}, {vote_sql("vc", "ev", "key", "ctcss_hz")}, {vote_sql("vd", "ev", "key", "dcs_code")}, {vote_sql("vp", "ev", "key", "dcs_polarity")}, {vote_sql("vm", "ev", "key", "modulation")}, {vote_sql("vk", "ev", "key", "content")},
td AS (SELECT k.key, CASE WHEN vs.value IS NULL OR vs.c * 10 < vs.total * 8 THEN 'unknown' WHEN vs.value = 'ctcss' AND NOT coalesce(vc.c * 10 >= vc.total * 8, false) THEN 'unknown'
    WHEN vs.value = 'dcs' AND NOT coalesce(vd.c * 10 >= vd.total * 8, true) THEN 'unknown' ELSE vs.value END AS tone_state, CAST(vc.value AS DOUBLE) AS c1, CAST(vd.value AS INT) AS d1, vp.value AS p1
  FROM (SELECT DISTINCT key FROM ck) k LEFT JOIN vs USING (key) LEFT JOIN vc USING (key) LEFT JOIN vd USING (key) LEFT JOIN vp USING (key)),
tone AS (SELECT key, tone_state, CASE WHEN tone_state = 'ctcss' THEN c1 END AS ctcss_hz, CASE WHEN tone_state = 'dcs' THEN d1 END AS dcs_code,
    CASE WHEN tone_state = 'dcs' THEN p1 END AS dcs_polarity FROM td)"""
ROLL_SQL = f"""{TONE_SQL}, sums AS (SELECT key, count(*) AS event_count, coalesce(sum(duration_s), 0) AS total_airtime_s, min(t_us) AS first_seen_us,
    max(t_us) AS last_seen_us,
    median(CASE WHEN snr_db >= 18 THEN deviation_hz END) AS med,
        count(CASE WHEN snr_db >= 18 THEN deviation_hz END) AS measured, median(freq_hz) AS mf FROM ev GROUP BY key),
pick AS (SELECT key, arg_min(freq_hz, (width_hz, freq_hz)) AS freq_hz FROM ck JOIN (SELECT DISTINCT freq_hz, width_hz FROM l
    WHERE r = 1) USING (freq_hz) GROUP BY key),
cand AS (SELECT key, l.*, CASE bandwidth_hz WHEN 12500 THEN 2500 WHEN 20000 THEN 5000 WHEN 25000 THEN 5000 END AS lim FROM pick JOIN l USING (freq_hz)
    WHERE r = 1),
lims AS (SELECT key, count(DISTINCT lim) AS limits, count(*) FILTER (WHERE lim IS NULL OR med <= lim + 1500) AS stay FROM cand JOIN sums USING (key)
    GROUP BY key),
tied AS (SELECT cand.* FROM cand JOIN lims USING (key) JOIN sums USING (key)
    WHERE NOT (coalesce(measured >= 3, false) AND limits >= 2 AND stay > 0) OR lim IS NULL OR med <= lim + 1500),
top AS (SELECT key, arg_min(service, place) AS service, arg_min(id, place) AS band_plan_id, arg_min(kind, place) AS kind,
    arg_min(coalesce(freq_center_hz, 0), place) AS center, arg_min(licensed, place) AS licensed,
    arg_min(is_repeater_out, place) AS is_repeater_out, string_agg(label, ' / ' ORDER BY place) AS label FROM tied GROUP BY key),
ch AS (SELECT s.key, CASE WHEN kind = 'channel' THEN center ELSE CAST(floor(mf) AS BIGINT) END AS freq_hz, service, label, band_plan_id, vm.value AS modulation, vk.value AS content, tone_state, ctcss_hz, dcs_code, dcs_polarity,
    first_seen_us, last_seen_us, event_count, total_airtime_s, round_even(med, 1) AS deviation_hz, licensed, is_repeater_out FROM sums s
        LEFT JOIN top USING (key) LEFT JOIN tone USING (key) LEFT JOIN vm USING (key) LEFT JOIN vk USING (key))"""
PAIR_SQL = f"""{ROLL_SQL}, off AS (SELECT DISTINCT pair_offset_hz AS offset_hz FROM plan WHERE pair_offset_hz IS NOT NULL),
pc AS (SELECT a.freq_hz AS output_hz, b.freq_hz AS input_hz, offset_hz FROM ch a CROSS JOIN off JOIN ch b ON b.freq_hz = a.freq_hz + offset_hz),
    pe AS (SELECT ev.id, t_us, ch.freq_hz AS channel_hz FROM ev JOIN ch USING (key)),
near AS (SELECT output_hz, input_hz, o.id AS out_id, i.id AS in_id, o.t_us - i.t_us AS lag_us,
    row_number() OVER (PARTITION BY output_hz, input_hz, o.id ORDER BY abs(o.t_us - i.t_us), i.t_us, i.id) AS rn
  FROM pc JOIN pe o ON o.channel_hz = output_hz JOIN pe i ON i.channel_hz = input_hz AND i.t_us BETWEEN o.t_us - {LAG_US} AND o.t_us + {LAG_US}),
pv AS (SELECT output_hz, input_hz, count(*) AS evidence_count, median(lag_us) AS median_lag_us, count(*) / n::DOUBLE AS share FROM near
    JOIN (SELECT channel_hz AS output_hz, count(*) AS n FROM pe GROUP BY ALL) USING (output_hz)
  WHERE rn = 1 AND n >= 3 GROUP BY output_hz, input_hz, n)"""
SHARE = 0.02  # of keyups that a pair must explain in these data
TIER_SQL = f"""{PAIR_SQL}, seen AS (SELECT output_hz, min(input_hz) AS input_hz FROM pv WHERE evidence_count >= 3 AND share >= {SHARE} GROUP BY ALL),
sc AS (SELECT ch.*, input_hz, CASE WHEN deviation_hz IS NULL THEN 0 WHEN tone_state NOT IN ('none', 'ctcss', 'dcs') THEN 1
    WHEN NOT ((tone_state = 'none' OR (tone_state = 'ctcss' AND ctcss_hz IS NOT NULL) OR (tone_state = 'dcs' AND dcs_code IS NOT NULL)) AND (coalesce(is_repeater_out, 0) = 0 OR input_hz IS NOT NULL)) THEN 2
    WHEN NOT (service IS NOT NULL AND (coalesce(licensed = 0, false) OR service IN ('gmrs'))) THEN 3 ELSE 4 END AS tier FROM ch
        LEFT JOIN seen ON output_hz = freq_hz)"""

# ---------------------------------------------------------------- band plan


@query(f"WITH {MATCH_SQL} SELECT sig.id, sig.freq_hz, l.id AS band_plan_id FROM sig LEFT JOIN l ON l.freq_hz = sig.freq_hz AND place = 1")
def tag_narrowest(spark, d):
    return bandplan.tag(sig(spark, d), plan(spark)).select("id", "freq_hz", "band_plan_id")


@query(f"""WITH {MATCH_SQL} SELECT id, freq_hz, CASE WHEN id % 4 = 0 THEN 999 ELSE b END AS band_plan_id FROM (SELECT sig.id, sig.freq_hz, l.id AS b
    FROM sig LEFT JOIN l ON l.freq_hz = sig.freq_hz AND place = 1)""")
def tag_untagged_only(spark, d):
    e = sig(spark, d).withColumn("band_plan_id", F.expr("if(id % 4 = 0, 999L, cast(null AS bigint))"))
    return bandplan.tag(e, plan(spark)).select("id", "freq_hz", "band_plan_id")


@query(f"WITH {MATCH_SQL} SELECT freq_hz, width_hz, string_agg(label, ' / ' ORDER BY place) AS labels, count(*) AS n FROM l WHERE r = 1 GROUP BY ALL")
def tag_tied(spark, d):
    t = bandplan.tied(sig(spark, d), plan(spark))
    return t.select("freq_hz", "width_hz", F.array_join(F.transform("tied", lambda x: x["label"]), " / ").alias("labels"), F.size("tied").cast("long").alias("n"))


@query(f"WITH {MATCH_SQL} SELECT freq_hz, id, label, width_hz, offset_hz, place FROM l")
def lookup_all(spark, d):
    return bandplan.lookup(sig(spark, d), plan(spark)).select("freq_hz", "id", "label", "width_hz", "offset_hz", "place")


@query(f"WITH {MATCH_SQL} SELECT freq_hz FROM f WHERE freq_hz NOT IN (SELECT freq_hz FROM m)")
def unallocated(spark, d):
    return bandplan.unallocated(sig(spark, d), plan(spark))


@query(f"""WITH {MATCH_SQL} SELECT freq_hz,
    coalesce(label || CASE WHEN o <> 0 THEN printf(' (%+.2f kHz)', o / 1000.0::DOUBLE) ELSE '' END || CASE WHEN n > 1 THEN ' in ' || around ELSE '' END, 'unallocated') AS text
  FROM f LEFT JOIN (SELECT freq_hz, arg_min(label, place) AS label, max(o) AS o, arg_max(label, place) AS around, max(place) AS n FROM (SELECT *,
      CASE WHEN place = 1 THEN freq_hz - freq_center_hz END AS o FROM l) GROUP BY ALL) USING (freq_hz)""")
def describe_frequency(spark, d):
    return bandplan.described(sig(spark, d), plan(spark))


@query("""WITH c AS (SELECT DISTINCT p_brand AS service, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS center, 20000 AS bandwidth FROM part), g AS (
  SELECT *, least(center - lag(center) OVER w, lead(center) OVER w - center) AS gap FROM c WINDOW w AS (PARTITION BY service ORDER BY center)),
      h AS (SELECT *, least(bandwidth // 2, coalesce(gap // 2, bandwidth // 2)) AS half FROM g)
  SELECT service, center, bandwidth, center - half AS lo, center + half - 1 AS hi FROM h""")
def plan_windows(spark, d):
    centers = table(spark, d, "part").select(F.col("p_brand").alias("service"), (F.floor("p_retailprice").cast("long") * 1000).alias("center"), F.lit(20000).alias("bandwidth")).distinct()
    return bandplan.nominal_windows(centers)


PART_PLAN_SQL = """pp AS (SELECT p_partkey AS id, p_brand AS service, p_type AS kind, CAST(floor(p_retailprice) AS BIGINT) * 1000 - p_size * 40 AS freq_lo_hz,
    CAST(floor(p_retailprice) AS BIGINT) * 1000 + p_size * 40 AS freq_hi_hz FROM part)"""


def part_plan(spark, d):
    """A plan with a range for each part: brands are services, types kinds, prices centers and sizes widths."""
    center = F.floor("p_retailprice").cast("long") * 1000
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("service"), F.col("p_type").alias("kind"), (center - F.col("p_size") * 40).alias("freq_lo_hz"), (center + F.col("p_size") * 40).alias("freq_hi_hz"))


@query(f"""WITH {PART_PLAN_SQL} SELECT a.service, a.id AS a, b.id AS b
    FROM pp a JOIN pp b ON a.service = b.service AND a.id < b.id AND a.freq_lo_hz <= b.freq_hi_hz AND b.freq_lo_hz <= a.freq_hi_hz""")
def plan_overlaps(spark, d):
    return bandplan.overlaps(part_plan(spark, d))


@query(f"WITH {PART_PLAN_SQL} SELECT service, kind, count(*) AS n, min(freq_lo_hz) AS lo, max(freq_hi_hz) AS hi FROM pp GROUP BY ALL")
def plan_summary(spark, d):
    return bandplan.summary(part_plan(spark, d))


@query(f"WITH {KEY_SQL} SELECT freq_hz, key FROM ck")
def channel_key(spark, d):
    return bandplan.channel_key(sig(spark, d), plan(spark))


# ---------------------------------------------------------------- aggregation


@query(f"""WITH src AS (SELECT *
    FROM orders), {vote_sql('v', 'src', 'o_custkey', 'o_orderpriority')} SELECT key AS o_custkey, value AS o_orderpriority, CAST(c AS BIGINT) AS agreeing, CAST(total AS BIGINT) AS total
    FROM v""")
def modal_agreement(spark, d):
    return enrich.modal(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query(f"WITH {TONE_SQL} SELECT * FROM tone")
def tone_decision(spark, d):
    e = enrich.keyed(sig(spark, d), plan(spark)).withColumn("state", F.when(F.col("tone_state") != "unknown", F.col("tone_state")))
    return enrich.tone_decision(enrich.votes(e, "key", ["state", "ctcss_hz", "dcs_code", "dcs_polarity"]), "key")


@query(f"""WITH {KEY_SQL} SELECT key, median(deviation_hz) AS median_hz, count(*) AS measured FROM sig JOIN ck USING (freq_hz)
    WHERE snr_db >= 18 AND deviation_hz IS NOT NULL GROUP BY key""")
def deviation_evidence(spark, d):
    e = enrich.keyed(sig(spark, d), plan(spark)).where(enrich.usable().isNotNull())
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("measured")).join(medians(e, ["key"], {"median_hz": F.col("deviation_hz")}), "key")


@query(f"WITH {ROLL_SQL} SELECT key, string_agg(label, ' / ' ORDER BY place) AS labels FROM tied GROUP BY key")
def narrow_by_deviation(spark, d):
    e = enrich.keyed(sig(spark, d), plan(spark))
    measured = e.groupBy("key").agg(F.count(enrich.usable()).alias("n")).join(medians(e, ["key"], {"m": enrich.usable()}), "key")
    joined = enrich.bucket_plans(e, plan(spark)).join(measured, "key")
    return joined.select("key", F.array_join(F.transform(enrich.narrowed(F.col("tied"), F.col("m"), F.col("n")), lambda t: t["label"]), " / ").alias("labels"))


@query(f"WITH {ROLL_SQL} SELECT * REPLACE (round(total_airtime_s, 4) AS total_airtime_s) FROM ch")
def rollup_channels(spark, d):
    return enrich.rollup(sig(spark, d), plan(spark)).withColumn("total_airtime_s", F.round("total_airtime_s", 4))


@query(f"WITH {ROLL_SQL} SELECT key, freq_hz FROM ch")
def reported_frequency(spark, d):
    return enrich.rollup(sig(spark, d), plan(spark)).select("key", "freq_hz")


@query(f"""WITH {ROLL_SQL}, old AS (SELECT freq_hz, 'note ' || freq_hz AS notes FROM ch
    WHERE key % 3 = 0) SELECT freq_hz, notes, 1.7e9::DOUBLE AS rebuilt_at FROM ch LEFT JOIN old USING (freq_hz)""")
def notes_kept(spark, d):
    channels = stored(enrich.rollup(sig(spark, d), plan(spark)), "channels")
    notes = channels.where("key % 3 = 0").select("freq_hz", F.concat(F.lit("note "), "freq_hz").alias("notes"))
    return enrich.stamped(channels.select("freq_hz").join(notes, "freq_hz", "left"), "rebuilt_at", 1.7e9)


# ---------------------------------------------------------------- pairs and tiers


def placed(spark, d):
    return enrich.placed(sig(spark, d), plan(spark))


def with_pairs(spark, d):
    channels, events = placed(spark, d)
    return channels, stored(enrich.pair_evidence(events, enrich.pair_candidates(channels, plan(spark)), LAG_US, min_confidence=SHARE), "pairs")


@query(f"WITH {PAIR_SQL} SELECT * FROM pc")
def pair_candidates(spark, d):
    return enrich.pair_candidates(placed(spark, d)[0], plan(spark))


@query(f"WITH {PAIR_SQL} SELECT output_hz, input_hz, out_id, in_id, lag_us FROM near WHERE rn = 1")
def pair_nearest(spark, d):
    channels, events = placed(spark, d)
    return enrich.pair_nearest(events, enrich.pair_candidates(channels, plan(spark)), LAG_US)


@query(f"""WITH {PAIR_SQL} SELECT output_hz, input_hz, evidence_count, median_lag_us, round_even(share, 3) AS confidence FROM pv
    WHERE evidence_count >= 3 AND share >= {SHARE}""")
def pair_evidence(spark, d):
    channels, events = placed(spark, d)
    return enrich.pair_evidence(events, enrich.pair_candidates(channels, plan(spark)), LAG_US, min_confidence=SHARE)


@query(f"""WITH {PAIR_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY output_hz, input_hz) AS id FROM pv
    WHERE evidence_count >= 3 AND share >= {SHARE})
  SELECT freq_hz, pair_id FROM ch LEFT JOIN (SELECT output_hz AS freq_hz, min(id) AS pair_id FROM p GROUP BY ALL) USING (freq_hz)""")
def channel_pair_ids(spark, d):
    channels, pairs = with_pairs(spark, d)
    return enrich.with_pair_ids(channels, pairs).select("freq_hz", "pair_id")


@query(f"WITH {PAIR_SQL} SELECT freq_hz, service FROM ch WHERE freq_hz IN (SELECT output_hz FROM pv WHERE evidence_count >= 3 AND share >= {SHARE})")
def paired_outputs(spark, d):
    channels, pairs = with_pairs(spark, d)
    return channels.join(pairs, channels["freq_hz"] == pairs["output_hz"], "left_semi").select("freq_hz", "service")


def scored(spark, d):
    channels, pairs = with_pairs(spark, d)
    seen = pairs.groupBy(F.col("output_hz").alias("freq_hz")).agg(F.min("input_hz").alias("input_hz"))
    return enrich.tiers(channels.join(seen, "freq_hz", "left").withColumn("paired", F.col("input_hz").isNotNull()), LICENCES)


@query(f"WITH {TIER_SQL} SELECT freq_hz, input_hz, tier FROM sc")
def score_tiers(spark, d):
    return scored(spark, d).select("freq_hz", "input_hz", "tier")


@query(f"WITH {TIER_SQL} SELECT CAST(range AS INT) AS tier, count(freq_hz) AS n FROM range(5) LEFT JOIN sc ON tier = range GROUP BY ALL")
def tier_histogram(spark, d):
    return enrich.tier_histogram(scored(spark, d))


# ---------------------------------------------------------------- views


@query(f"""WITH {ROLL_SQL} SELECT ev.id, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S') AS at, ev.freq_hz, printf('%d.%04d', (ev.freq_hz + 50) // 1000000, (ev.freq_hz + 50) // 100 % 10000) AS mhz,
    CASE WHEN duration_s IS NULL THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN ev.ctcss_hz IS NOT NULL THEN printf('CTCSS %.1f', ev.ctcss_hz) WHEN ev.dcs_code IS NOT NULL THEN printf('DCS %03d', ev.dcs_code) || coalesce(ev.dcs_polarity, '') WHEN ev.tone_state = 'dcs' THEN 'DCS?' WHEN ev.tone_state = 'none' THEN 'no tone' ELSE '?' END AS tone,
  snr_db, ev.deviation_hz, CASE WHEN overload = 1 THEN 'OVL' END AS ovl, coalesce(ch.label, l.label) AS label, t_us
  FROM ev LEFT JOIN ch ON ch.key = ev.key LEFT JOIN l ON l.freq_hz = ev.freq_hz AND l.place = 1""")
def v_events(spark, d):
    places = stored(bandplan.places(sig(spark, d), plan(spark)), "places")
    e = sig(spark, d).join(places.select("freq_hz", "key", F.col("tied")[0]["id"].alias("band_plan_id")), "freq_hz")
    return views.events_view(e, enrich.rollup(sig(spark, d), plan(spark), places=places), plan(spark))


@query(f"""WITH {SIG_SQL} SELECT freq_hz, count(*) AS hits, count(*) FILTER (WHERE duration_s IS NULL) AS open,
    round(sum(duration_s), 4) AS airtime_s, round(avg(snr_db), 4) AS snr_db, round(avg(deviation_hz), 4) AS deviation_hz, min(t_us) AS first_us,
    max(t_us) AS last_us FROM sig GROUP BY ALL""")
def v_activity(spark, d):
    return views.activity(sig(spark, d))


@query(f"""WITH {TIER_SQL} SELECT a.freq_hz, a.service, a.label, a.tier,
    CASE WHEN a.ctcss_hz IS NOT NULL THEN printf('CTCSS %.1f', a.ctcss_hz) WHEN a.dcs_code IS NOT NULL THEN printf('DCS %03d', a.dcs_code) || coalesce(a.dcs_polarity, '')
  WHEN a.tone_state = 'dcs' THEN 'DCS?' WHEN a.tone_state = 'none' THEN 'no tone' ELSE '?' END AS tone, a.input_hz, b.label AS input_label,
      round(a.total_airtime_s, 4) AS airtime_s, a.event_count FROM sc a LEFT JOIN sc b ON b.freq_hz = a.input_hz""")
def v_contactable(spark, d):
    return views.contactable(scored(spark, d))


@query(f"""WITH {SIG_SQL}, {WINDOWS_SQL},
    heard AS (SELECT t_us // 86400000000 * 100 + run_id * 10 + CASE WHEN receiver_id = 'vhf' THEN 1 ELSE 0 END AS id, count(*) AS n FROM sig
    GROUP BY ALL)
  SELECT run_id, receiver_id, center_hz,
      coalesce(arg_min_null(label, id), printf('%d.%03d MHz', center_hz // 1000000, center_hz // 1000 % 1000)) AS label,
      count(DISTINCT id) AS windows, CAST(sum(coalesce(t_end_us, t_start_us) - t_start_us) AS BIGINT) AS listened_us, CAST(sum(coalesce(n, 0)) AS BIGINT) AS events
      FROM win LEFT JOIN heard USING (id) GROUP BY run_id, receiver_id, center_hz""")
def v_coverage(spark, d):
    e = sig(spark, d).withColumn("window_id", F.expr("t_us div 86400000000 * 100 + run_id * 10 + if(receiver_id = 'vhf', 1, 0)"))
    return views.coverage(windows(spark, d), e)


@query(f"""WITH {SIG_SQL}, {WINDOWS_SQL} SELECT win.id, count(sig.id) AS events FROM win
    LEFT JOIN sig ON sig.run_id = win.run_id AND sig.receiver_id = win.receiver_id AND t_us BETWEEN t_start_us AND coalesce(t_end_us, 9223372036854775807)
    GROUP BY ALL""")
def v_coverage_time_range(spark, d):
    return views.coverage_by_time(windows(spark, d), sig(spark, d))


@query(f"""WITH {SIG_SQL}, {WINDOWS_SQL} SELECT sig.id, win.id AS window_id, center_hz, win.label AS window_label
  FROM sig LEFT JOIN win ON win.id = t_us // 86400000000 * 100 + sig.run_id * 10 + CASE WHEN sig.receiver_id = 'vhf' THEN 1 ELSE 0 END""")
def events_in_windows(spark, d):
    e = sig(spark, d).withColumn("window_id", F.expr("t_us div 86400000000 * 100 + run_id * 10 + if(receiver_id = 'vhf', 1, 0)"))
    return views.in_windows(e, windows(spark, d)).select("id", "window_id", "center_hz", "window_label")


@query(f"""WITH {SIG_SQL}, r AS (SELECT run_id, count(*) AS events,
    count(*) FILTER (WHERE duration_s IS NULL) AS open, (max(t_us) - min(t_us)) / 3.6e9::DOUBLE AS hours FROM sig GROUP BY ALL)
  SELECT run_id, events, open, round(hours, 4) AS hours, CASE WHEN hours > 0 THEN round(events / hours, 4) END AS per_hour FROM r""")
def run_statistics(spark, d):
    return views.run_statistics(sig(spark, d))


@query(f"""WITH {SIG_SQL} SELECT freq_hz, count(*) AS hits, round(avg(snr_db), 1) AS snr_db, arg_min_null(ctcss_hz, id) AS ctcss_hz,
    count(*) FILTER (WHERE tone_state = 'dcs') AS dcs FROM sig GROUP BY ALL ORDER BY hits DESC, freq_hz LIMIT 25""")
def busiest_channels(spark, d):
    return views.busiest(sig(spark, d))


@query(f"WITH {SIG_SQL} SELECT id, t_us, freq_hz, tone_state FROM sig ORDER BY id DESC LIMIT 15")
def last_events(spark, d):
    return views.latest(sig(spark, d).select("id", "t_us", "freq_hz", "tone_state"))


@query(f"""WITH {SIG_SQL} SELECT count(*) AS events, CAST(sum(overload) AS BIGINT) AS overloads,
    count(*) FILTER (WHERE duration_s IS NULL) AS open, 8 AS version FROM sig""")
def db_summary(spark, d):
    return views.totals(sig(spark, d), spark.range(1).select(F.lit(schemas.VERSION).alias("version")))


@query("""SELECT o_orderkey, items FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, string_agg(l_linenumber || '=' || l_suppkey, ' '
    ORDER BY l_linenumber, l_linenumber || '=' || l_suppkey) AS items FROM lineitem GROUP BY ALL) USING (o_orderkey)""")
def runs_receivers_concat(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return views.concatenated(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", F.concat_ws("=", "l_linenumber", "l_suppkey"), "l_linenumber")


@query(f"WITH {SIG_SQL} SELECT freq_hz // 12500 * 12500 AS bin_hz, count(*) AS n FROM sig GROUP BY ALL")
def freq_histogram(spark, d):
    return views.histogram(sig(spark, d))


@query(f"""WITH {SIG_SQL}, e AS (SELECT {bridge.BASE_HZ} AS freq_hz, freq_hz AS raw FROM sig
    WHERE freq_hz BETWEEN {bridge.BASE_HZ - 300} AND {bridge.BASE_HZ + 300}) SELECT round(avg(raw - freq_hz), 4) AS error_hz,
    round(avg(raw - freq_hz) / {bridge.BASE_HZ / 1e6}, 4) AS ppm FROM e""")
def ppm_error(spark, d):
    e = sig(spark, d).where(F.col("freq_hz").between(bridge.BASE_HZ - 300, bridge.BASE_HZ + 300)).withColumns({"freq_raw_hz": F.col("freq_hz")}).withColumn("freq_hz", F.lit(bridge.BASE_HZ))
    return views.ppm(e, bridge.BASE_HZ)


# ---------------------------------------------------------------- detection


@query("""WITH p AS (SELECT l_partkey AS channel, round(sum(l_extendedprice) / 1e4, 2) AS power FROM lineitem GROUP BY ALL) SELECT * FROM p
    WHERE power >= 40 ORDER BY power DESC, channel LIMIT 25""")
def find_peaks(spark, d):
    power = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("channel")).agg(F.round(F.sum("l_extendedprice") / 1e4, 2).alias("power"))
    return views.peaks(power, "channel", "power", 40)


GRID_SQL = "grid AS (SELECT epoch_us(ts) // 86400000000 AS frame, user_id AS channel, max(value) AS value FROM events GROUP BY ALL)"


def grid(spark, d):
    return table(spark, d, "events").groupBy(F.expr("unix_micros(cast(ts AS timestamp)) div 86400000000").alias("frame"), F.col("user_id").alias("channel")).agg(F.max("value").alias("value"))


@query(f"""WITH {GRID_SQL}, n AS (SELECT *, coalesce(lag(value) OVER w, '-infinity'::DOUBLE) AS a,
    coalesce(lead(value) OVER w, '-infinity'::DOUBLE) AS b FROM grid WINDOW w AS (PARTITION BY frame ORDER BY channel)) SELECT frame, channel, value
    FROM n WHERE value >= a AND value >= b""")
def local_max(spark, d):
    return detect.local_maxima(grid(spark, d), "frame", "channel", "value")


@query(f"""WITH {GRID_SQL}, g AS (SELECT channel, CAST(round(value * 1000) AS BIGINT) AS value FROM grid)
  SELECT channel, avg(value) AS mean, max(value) AS peak, max(value) - (SELECT median(m) FROM (SELECT median(value) AS m FROM g
      GROUP BY channel)) AS above FROM g GROUP BY channel""")
def spectrum_snapshot(spark, d):
    # levels in whole thousandths, whose sums and medians are exact in either engine
    return detect.spectrum_snapshot(grid(spark, d).withColumn("value", F.round(F.col("value") * 1000).cast("long")), "channel", "value")


SEQ_SQL = "seq AS (SELECT user_id, event_id, epoch_us(ts) AS t_us, value FROM events)"


def seq(spark, d):
    return table(spark, d, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts AS timestamp)) AS t_us", "value")


@query(f"""WITH {SEQ_SQL}, i AS (SELECT *, value >= 40 AS hot, sum(CASE WHEN value >= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id
    ORDER BY t_us, event_id) AS island FROM seq)
  SELECT event_id, CAST(sum(CASE WHEN hot THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY t_us, event_id) AS BIGINT) AS above
      FROM i""")
def run_lengths(spark, d):
    return detect.run_lengths(seq(spark, d), "user_id", ["t_us", "event_id"], F.col("value") >= 40, "above").select("event_id", "above")


@query(f"""WITH {SEQ_SQL}, i AS (SELECT *, sum(CASE WHEN value >= 40 THEN 0 ELSE 1 END) OVER w AS ia,
    sum(CASE WHEN value < 25 THEN 0 ELSE 1 END) OVER w AS ib FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
  r AS (SELECT *, sum(CASE WHEN value >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ia ORDER BY t_us, event_id) AS above,
      sum(CASE WHEN value < 25 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ib ORDER BY t_us, event_id) AS below FROM i),
  s AS (SELECT *, coalesce(last_value(CASE WHEN above >= 2 THEN 1 WHEN below >= 2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id
      ORDER BY t_us, event_id), 0) AS act FROM r),
  t AS (SELECT *, coalesce(lag(act) OVER w, 0) AS was, coalesce(lag(t_us, 1) OVER w, first_value(t_us) OVER w) AS back
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
  n AS (SELECT *, sum(CASE WHEN act = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS event_no FROM t)
  SELECT user_id, CAST(event_no AS BIGINT) AS event_no, min(CASE WHEN act = 1 AND was = 0 THEN back END) AS start,
      min(CASE WHEN act = 0 AND was = 1 THEN back END) AS "end", max(CASE WHEN act = 1 THEN value END) AS peak FROM n WHERE act = 1 OR was = 1
      GROUP BY ALL""")
def tracker_events(spark, d):
    return detect.tracked(seq(spark, d), "user_id", ["t_us", "event_id"], "value", "t_us", on=40, off=25, least=2, hang=2)


@query(f"""WITH {SEQ_SQL}, p AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id
    ORDER BY t_us, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS past FROM seq)
  SELECT event_id, CASE WHEN len(past) >= 20 THEN past[least(30, len(past) - 1) + 1] END AS floor FROM p""")
def rolling_floor(spark, d):
    return detect.rolling_floor(seq(spark, d), "user_id", ["t_us", "event_id"], "value").select("event_id", "floor")


@query(f"""WITH {SEQ_SQL}, b AS (SELECT event_id, value, event_id % 50 = 0 AS clip,
    CASE WHEN count(*) OVER w >= 60 THEN quantile_cont(value, 0.2) OVER w END AS baseline FROM seq WINDOW w AS (PARTITION BY user_id
    ORDER BY t_us, event_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(baseline, 6) AS baseline, CAST(coalesce(value - baseline > 6, false) OR clip AS INT) AS overload FROM b""")
def overload_flags(spark, d):
    rows = seq(spark, d).withColumn("clip", F.expr("if(event_id % 50 = 0, 0.001D, 0D)"))
    return detect.overload_flags(rows, "user_id", ["t_us", "event_id"], "value", "clip").select("event_id", F.round("baseline", 6).alias("baseline"), "overload")


@query(f"""WITH {SEQ_SQL}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh
    FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id
    ORDER BY t_us, event_id) AS no FROM g)
  SELECT user_id, min(t_us) AS start_us, count(*) AS n FROM s GROUP BY user_id, no""")
def session_approx(spark, d):
    e = seq(spark, d).withColumn("at", F.timestamp_micros("t_us"))
    return detect.sessions(e, "user_id", "at", "1 hour").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""WITH e AS (SELECT event_id AS id, event_id * 37 % 100000 AS start,
    CASE WHEN event_id % 6 <> 0 THEN event_id * 37 % 100000 + user_id * 13 % 3000 END AS stop, event_id * 37 % 100000 + user_id * 29 % 4000 AS written
    FROM events),
  f AS (SELECT *, greatest(start - 300, 0) AS first FROM e), n AS (SELECT *,
      CASE WHEN coalesce(stop + 300, written) >= first + 1200 THEN 1200 WHEN stop IS NOT NULL THEN least(stop - first, 1200) END AS n FROM f)
  SELECT id, first, CASE WHEN n >= 120 THEN n END AS length FROM n""")
def analysis_ranges(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "event_id * 37 % 100000 AS start", "if(event_id % 6 <> 0, event_id * 37 % 100000 + user_id * 13 % 3000, null) AS end", "event_id * 37 % 100000 + user_id * 29 % 4000 AS written")
    return excerpts.ranges(e, 1000.0).select("id", "first", "length")


# ---------------------------------------------------------------- mutations and checks


@query("SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 1000000")
def retention_budget(spark, d):
    return views.running_budget(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000).select("doc_id", "used")


LOG_SQL = """log AS (SELECT o_orderkey AS id, 1 AS seq, o_orderdate AS opened, NULL AS status, NULL::DOUBLE AS total FROM orders UNION ALL
  SELECT o_orderkey, 2, NULL, o_orderstatus, NULL FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 3, NULL, NULL, o_totalprice
      FROM orders WHERE o_orderkey % 2 = 0)"""


@query(f"WITH {LOG_SQL} SELECT id, max(opened) AS opened, max(status) AS status, max(total) AS total FROM log GROUP BY id")
def event_log_latest(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    none = lambda t: F.lit(None).cast(t)
    log = o.select("id", F.lit(1).alias("seq"), F.col("o_orderdate").alias("opened"), none("string").alias("status"), none("double").alias("total"))
    log = log.union(o.where("id % 3 <> 0").select("id", F.lit(2), none("timestamp_ntz"), "o_orderstatus", none("double"))).union(o.where("id % 2 = 0").select("id", F.lit(3), none("timestamp_ntz"), none("string"), "o_totalprice"))
    return mutations.latest(log, "id", "seq", ["opened", "status", "total"])


@query(f"""WITH {SIG_SQL}, a AS (SELECT *, id % 4 <> 0 AS done, CASE WHEN id % 12 = 1 THEN 155 END AS code,
    CASE WHEN id % 12 = 2 THEN 88.5::DOUBLE END AS tone FROM sig)
  SELECT id, run_id, receiver_id, t_us / 1e6::DOUBLE AS t_start, freq_hz, overload, t_us // 86400000000 AS window_id,
    CASE WHEN NOT done THEN 'unknown' WHEN code IS NOT NULL THEN 'dcs' WHEN tone IS NOT NULL THEN 'ctcss' WHEN id % 12 = 3 THEN 'dcs' WHEN id % 12 <> 5 THEN 'none' ELSE 'unknown' END AS tone_state,
    CASE WHEN done THEN CAST(round_even(freq_hz + (id % 7 - 3) * 10.5::DOUBLE, 0) AS BIGINT) END AS freq_raw_hz,
        CASE WHEN done THEN deviation_hz END AS deviation_hz, CASE WHEN done THEN tone END AS ctcss_hz,
    CASE WHEN done THEN 0.0::DOUBLE END AS ctcss_dev_hz, CASE WHEN done THEN code END AS dcs_code,
        CASE WHEN done AND code IS NOT NULL THEN 'N' END AS dcs_polarity, NULL::INT AS dcs_errors,
    CASE WHEN done THEN 0.9::DOUBLE END AS analyzed_s, CASE WHEN done THEN 0.5::DOUBLE END AS confidence,
        CASE WHEN duration_s IS NOT NULL THEN t_us / 1e6::DOUBLE + 1 END AS t_end, duration_s,
    CASE WHEN duration_s IS NOT NULL THEN snr_db END AS snr_db, CASE WHEN id % 10 = 0 THEN 'audio/' || id || '.wav' END AS audio_path,
        CASE WHEN id % 10 = 0 THEN 'iq/' || id || '.npz' END AS iq_path FROM a""")
def event_lifecycle(spark, d):
    e = sig(spark, d).withColumn("t_start", F.col("t_us") / F.lit(1e6))
    start = lifecycle.started(e.withColumn("window_id", F.expr("t_us div 86400000000")))
    results = e.where("id % 4 <> 0").select(
        "id", "freq_hz", F.expr("(id % 7 - 3) * 10.5D AS freq_error_hz"), "deviation_hz", F.expr("if(id % 12 = 2, 88.5D, null) AS ctcss_hz"), F.lit(0.0).alias("ctcss_dev_hz"), F.expr("if(id % 12 = 1, 155, null) AS dcs_code"),
        F.expr("if(id % 12 = 1, 'N', null) AS dcs_polarity"), F.lit(None).cast("int").alias("dcs_errors"), F.lit(0.9).alias("analyzed_s"), F.lit(0.5).alias("ctcss_conf"), F.expr("id % 12 = 3 AS dcs_suspected"), F.expr("id % 12 <> 5 AS tone_checked"),
    )
    ends = e.where("duration_s IS NOT NULL").select("id", (F.col("t_start") + 1).alias("t_end"), "duration_s", F.col("snr_db").alias("peak_snr"))
    files = e.where("id % 10 = 0").select("id", F.concat(F.lit("audio/"), "id", F.lit(".wav")).alias("audio_path"), F.concat(F.lit("iq/"), "id", F.lit(".npz")).alias("iq_path"))
    return lifecycle.folded(start, lifecycle.analysed(results), lifecycle.closed(ends), lifecycle.captured(files))


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN 999.0 ELSE p_retailprice END AS p_retailprice FROM part
    UNION ALL SELECT p_partkey + 100000000, p_name, 1.0 FROM part WHERE p_partkey % 10 = 0""")
def upsert_plan(spark, d):
    old = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    new = old.where("p_partkey % 5 = 0").withColumn("p_retailprice", F.lit(999.0)).union(old.where("p_partkey % 10 = 0").select(F.col("p_partkey") + 100_000_000, "p_name", F.lit(1.0)))
    return mutations.upserted(old, new, ["p_partkey"])


@query("""SELECT 'orders' AS tab, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_custkey % 7 <> 0
    UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
    WHERE o_custkey % 7 = 0)""")
def delete_cascade(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    left, below = mutations.cascaded(orders, lines, "o_orderkey", "l_orderkey", orders.where("o_custkey % 7 = 0"))
    one = lambda df, name, key: df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))
    return one(left, "orders", "o_orderkey").union(one(below, "lineitem", "l_orderkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0)")
def fk_check(spark, d):
    return schemas.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderkey % 11 <> 0"), "o_orderkey").select("l_orderkey", "l_linenumber")


@query(f"""WITH {SIG_SQL} SELECT 'duration' AS rule, count(*) FILTER (WHERE NOT duration_s < 200) AS n FROM sig UNION ALL SELECT 'one_tone_kind',
    count(*) FILTER (WHERE ctcss_hz IS NOT NULL AND dcs_code IS NOT NULL) FROM sig
  UNION ALL SELECT 'tone_state', count(*) FILTER (WHERE tone_state NOT IN ('none', 'ctcss')) FROM sig""")
def constraint_violations(spark, d):
    rules = {"duration": F.col("duration_s") < 200, "one_tone_kind": schemas.checks("events")["one_tone_kind"], "tone_state": schemas.within("tone_state", "none", "ctcss")}
    return schemas.violations(sig(spark, d), rules)


@query(f"WITH {SIG_SQL} SELECT freq_hz, count(*) AS n FROM sig GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return schemas.duplicates(sig(spark, d), ("freq_hz",))


# ---------------------------------------------------------------- codes, signals and the recursive detector

GOLAY_SQL = "list_reduce(list_concat([{high}], range(22, 10, -1)), lambda v, i: CASE WHEN (v >> i) & 1 = 1 THEN xor(v, 3189::BIGINT << (i - 11)) ELSE v END)"


@query("WITH w AS (SELECT p_partkey % 4096 AS data FROM part GROUP BY ALL) SELECT data, (data << 11) | (" + GOLAY_SQL.format(high="data::BIGINT << 11") + ") AS word FROM w")
def golay_encode(spark, d):
    w = table(spark, d, "part").select(F.expr("p_partkey % 4096").alias("data")).distinct()
    return w.select("data", golay.encoded(F.col("data")).alias("word"))


CODES_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in golay.CODES) + ") AS t(code)"
OCTAL_SQL = "printf('%d%d%d', data % 512 // 64, data % 64 // 8, data % 8)"


@query(f"""WITH w AS (SELECT p_partkey, p_partkey % 4096 AS data, p_partkey % 3 AS errors FROM part), c AS (SELECT code FROM {CODES_SQL})
  SELECT p_partkey, data, errors, CASE WHEN data // 512 = 4 AND {OCTAL_SQL} IN (SELECT code FROM c) THEN {OCTAL_SQL} END AS code FROM w""")
def golay_decode(spark, d):
    w = table(spark, d, "part").select("p_partkey", golay.encoded(F.expr("p_partkey % 4096")).alias("word"))
    flips = F.expr("CASE p_partkey % 3 WHEN 0 THEN 0L WHEN 1 THEN shiftleft(1L, cast(p_partkey % 23 AS int)) ELSE shiftleft(1L, cast(p_partkey % 23 AS int)) ^ shiftleft(1L, cast((p_partkey + 9) % 23 AS int)) END")
    return golay.decoded(w.withColumn("word", F.col("word").bitwiseXOR(flips))).select("p_partkey", "data", F.col("errors").cast("long").alias("errors"), "code")


def values(rows: list[tuple], columns: str) -> str:
    """Rows as an SQL table."""

    def text(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({columns})"


def names(spec: str) -> str:
    return ", ".join(c.split()[0] for c in spec.split(", "))


HEARD_SQL = "(462500000 + event_id % 5200 * 1000)"
SEED_COLUMNS = "service, label, channel_number, freq_lo_hz, freq_hi_hz, freq_center_hz, bandwidth_hz, kind, is_repeater_out, pair_offset_hz, licensed, source, notes"


@query(f"""WITH n AS (SELECT * FROM {values(seed.nominal_rows(), names(seed.NOMINAL))}), g AS (
    SELECT *, least(center - lag(center) OVER w, lead(center) OVER w - center) AS gap FROM n WINDOW w AS (PARTITION BY service ORDER BY center)),
        h AS (
    SELECT *, least(bandwidth // 2, coalesce(gap // 2, bandwidth // 2)) AS half FROM g), r AS (SELECT *
        FROM {values(seed.range_rows(), names(seed.RANGES))}), a AS (
    SELECT service, label, channel_number, center - half AS freq_lo_hz, center + half - 1 AS freq_hi_hz, center AS freq_center_hz, bandwidth AS bandwidth_hz, 'channel' AS kind, is_repeater_out, pair_offset_hz, licensed, source, notes
        FROM h
    UNION ALL SELECT service, label, NULL, freq_lo_hz, freq_hi_hz, freq_center_hz, bandwidth_hz, kind, is_repeater_out, pair_offset_hz, licensed, source, notes
        FROM r)
  SELECT {SEED_COLUMNS}, row_number() OVER (ORDER BY service, freq_lo_hz, label) AS id, (SELECT count(*) FROM events
      WHERE {HEARD_SQL} BETWEEN freq_lo_hz AND freq_hi_hz) AS events FROM a""")
def seeded_plan(spark, d):
    """The seeded plan, with the events that each range holds."""
    heard = table(spark, d, "events").selectExpr(f"{HEARD_SQL} AS freq_hz").groupBy("freq_hz").agg(F.count(F.lit(1)).alias("n"))
    p = seed.seeded(spark)
    held = bandplan.contained(heard.select("freq_hz"), p).join(heard, "freq_hz").groupBy("id").agg(F.sum("n").alias("n"))
    return p.join(held, "id", "left").select(*SEED_COLUMNS.split(", "), "id", F.coalesce("n", F.lit(0)).alias("events"))


FULL = (1 << 23) - 1


@query(f"""WITH c AS (SELECT code, (2048 + CAST(code[1] AS BIGINT) * 64 + CAST(code[2] AS BIGINT) * 8 + CAST(code[3] AS BIGINT)) << 11 AS high
    FROM {CODES_SQL}),
  w AS (SELECT code, high | ({GOLAY_SQL.format(high="high")}) AS word FROM c),
  t AS (SELECT code, ((({FULL} - word) >> k) | (({FULL} - word) << (23 - k))) & {FULL} AS word FROM w, range(23) AS r(k)),
  p AS (SELECT DISTINCT t.code, w.code AS reads_as FROM t JOIN w ON t.word = w.word),
  e AS (SELECT lpad(CAST(event_id % 8 * 100 + event_id // 8 % 8 * 10 + event_id // 64 % 8 AS VARCHAR), 3, '0') AS code, count(*) AS n FROM events GROUP BY ALL)
  SELECT code, reads_as, coalesce(n, 0) AS events FROM p LEFT JOIN e USING (code)""")
def dcs_pairs(spark, d):
    """Code pairs, with the events whose three octal digits are the code."""
    octal = F.expr("lpad(cast(event_id % 8 * 100 + event_id div 8 % 8 * 10 + event_id div 64 % 8 AS string), 3, '0') AS code")
    heard = table(spark, d, "events").select(octal).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return golay.inverse_pairs(spark).join(heard, "code", "left").select("code", "reads_as", F.coalesce("n", F.lit(0)).alias("events"))


@query()
def signal_analysis(spark, d):
    return signals.analysed(stations.signals(spark, d), ["station", "kind"]).withColumn("tone_state", signals.tone_state())


@query()
def channel_power(spark, d):
    return spectrum.by_channel(spectrum.powers(stations.samples(spark, d), stations.RATE_HZ, 1024))


@query()
def detector_batch(spark, d):
    return detector.detect(stations.frames(spark, d), stations.FRAME_S)


@query()
def detector_stream(spark, d):
    return detector.replayed(stations.frames(spark, d), stations.FRAME_S)


@query()
def detector_log(spark, d):
    """Events of frames that come out of order, flagged and detected as a stream, begun and ended as rows of a log."""
    job = lambda s: detector.detect_stream(receiver.in_order(s, "2 hours"), stations.FRAME_S, log=True)
    return detector.standing(detector.shuffled(stations.frames(spark, d), job, 4, 7200))


@query(ORACLES["overload_flags"])
def overload_stream(spark, d):
    """The flags of ``overload_flags``, made by the stream's monitor from rows that come out of order."""
    rows = seq(spark, d).selectExpr("cast(user_id AS string) AS receiver_id", "0L AS window_id", "event_id AS frame_no", "t_us AS frame_start", "timestamp_micros(t_us) AS at", "array(value) AS power_db", "value AS wideband_db", "if(event_id % 50 = 0, 0.001D, 0D) AS clip_frac")
    out = detector.shuffled(rows, lambda s: receiver.in_order(s, "2 days"), 4, 172_800)
    return out.select(F.col("frame_no").alias("event_id"), F.round("baseline", 6).alias("baseline"), "overload")


@query("""SELECT p_brand AS service, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS center, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""")
def duplicate_centers(spark, d):
    """What ``plan_windows`` would refuse if it took parts as they are."""
    return bandplan.duplicate_centers(table(spark, d, "part").select(F.col("p_brand").alias("service"), (F.floor("p_retailprice").cast("long") * 1000).alias("center")))


@query(f"""WITH {PAIR_SQL}, c AS (SELECT freq_hz, row_number() OVER (ORDER BY freq_hz) AS id FROM ch)
  SELECT row_number() OVER (ORDER BY output_hz, input_hz) AS id, o.id AS output_channel_id, i.id AS input_channel_id, input_hz - output_hz AS offset_hz, evidence_count,
    median_lag_us / 1e6::DOUBLE AS median_lag_s, round_even(share, 3) AS confidence, 1.5e9::DOUBLE AS inferred_at
  FROM pv JOIN c o ON o.freq_hz = output_hz JOIN c i ON i.freq_hz = input_hz WHERE evidence_count >= 3 AND share >= {SHARE}""")
def pair_rows(spark, d):
    channels, pairs = with_pairs(spark, d)
    return enrich.pair_rows(enrich.with_ids(channels), pairs, 1.5e9)


@query(f"""WITH {SIG_SQL}, {WINDOWS_SQL}, r AS (SELECT run_id, count(DISTINCT receiver_id) AS receivers, count(*) AS windows, count(*) FILTER (WHERE t_end_us IS NULL) AS open,
    coalesce(sum(t_end_us - t_start_us), 0) AS us, min(t_start_us) AS a, max(t_end_us) AS b FROM win GROUP BY run_id)
  SELECT run_id AS id, a / 1e6::DOUBLE AS started_at, CASE WHEN run_id % 2 = 0 THEN b / 1e6::DOUBLE END AS ended_at, receivers, windows, open, round(us / 1e6::DOUBLE, 3) AS listened_s FROM r""")
def run_lifecycle(spark, d):
    """Runs, their receivers and windows begun and ended as rows of logs, folded; odd runs have not ended."""
    w = windows(spark, d)
    runs = w.groupBy(F.col("run_id").alias("id")).agg(F.min("t_start_us").alias("a"), F.max("t_end_us").alias("b"))
    steps = [lifecycle.run_started(runs.select("id", "a"), F.col("a") / 1e6).drop("a"), lifecycle.run_ended(runs.where("id % 2 = 0"), F.col("b") / 1e6)]
    opened = lifecycle.window_opened(w.select("id", "run_id", "receiver_id", "center_hz", "label", "t_start_us"), F.col("t_start_us") / 1e6).drop("t_start_us")
    listened = lifecycle.folded(opened, lifecycle.window_closed(w.where("t_end_us IS NOT NULL"), F.col("t_end_us") / 1e6))
    receivers = lifecycle.registered(w.groupBy("run_id", "receiver_id").agg(F.min_by("center_hz", "t_start_us").alias("center_hz")).withColumn("serial", F.concat(F.lit("serial of "), "receiver_id")))
    return lifecycle.standing(lifecycle.folded(*steps), listened, receivers).withColumn("listened_s", F.round("listened_s", 3))


@query()
def excerpt_stream(spark, d):
    """What the measured frames held around each event, cut while they stream; a frame's samples are its channels' levels."""
    frames = stations.frames(spark, d).select("receiver_id", "window_id", "frame_start", "power_db", F.lit(0).alias("overload"), F.col("power_db").cast("array<float>").alias("i"), F.transform("power_db", lambda x: F.lit(0.0).cast("float")).alias("q"))
    frames = frames.withColumn("frame_start", F.col("frame_start") % stations.DAY_US / stations.FRAME_US * stations.CHANNELS).withColumn("frame_start", F.col("frame_start").cast("long"))
    out = detector.drained(frames, [frames], lambda s: excerpt.excerpted(s, stations.FRAME_S, stations.CHANNELS), "excerpts")
    mean = F.aggregate("i", F.lit(0.0), lambda a, x: a + x) / F.size("i")
    return out.select("receiver_id", "window_id", "channel", "start", "end", "first", "length", F.size("i").alias("samples"), F.round(mean, 3).alias("mean_db"))
