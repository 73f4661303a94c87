"""The seeded band plan: 85 channels and 32 segments, with windows worked out from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandplan

KHZ, MHZ = 1_000, 1_000_000

#: Fixed values. Runs of channels: service, label, first number, last, first Hz, bandwidth, licensed, source, notes; steps are 25 kHz.
RUNS = (
    ("frs", "FRS", 1, 7, 462_562_500, 12_500, 0, "FCC 95B", "2 W"),
    ("frs", "FRS", 8, 14, 467_562_500, 12_500, 0, "FCC 95B", "0.5 W"),
    ("frs", "FRS", 15, 22, 462_550_000, 12_500, 0, "FCC 95B", "2 W"),
    ("gmrs", "GMRS", 1, 7, 462_562_500, 12_500, 1, "FCC 95E", "5 W simplex"),
    ("gmrs", "GMRS", 8, 14, 467_562_500, 12_500, 1, "FCC 95E", "0.5 W simplex only"),
)
GMRS_FIRST, GMRS_HZ, GMRS_OFFSET = (15, 22), 462_550_000, 5 * MHZ
GMRS_NOTE = "50 W, repeater output"
GMRS_NOTES = {
    462_575_000: "50 W, repeater output; legacy White Dot — preprogrammed on cheap radios",
    462_625_000: "50 W, repeater output; legacy Black Dot — preprogrammed on cheap radios",
    462_675_000: "50 W, repeater output; legacy Orange Dot — preprogrammed on cheap radios",
}
MURS = (
    (151_820_000, "MURS 820", 11_250, "11.25 kHz bandwidth"),
    (151_880_000, "MURS 880", 11_250, "11.25 kHz bandwidth"),
    (151_940_000, "MURS 940", 11_250, "11.25 kHz bandwidth"),
    (154_570_000, "MURS 570", 20_000, "20 kHz bandwidth; legacy Blue Dot, moved from Part 90 in 2002"),
    (154_600_000, "MURS 600", 20_000, "20 kHz bandwidth; legacy Green Dot, moved from Part 90 in 2002"),
)
ITINERANT = (
    (151_505_000, "Itinerant 151.505", None),
    (151_512_500, "Itinerant 151.5125", None),
    (151_625_000, "Red Dot", None),
    (151_700_000, "Itinerant 151.700", None),
    (151_760_000, "Itinerant 151.760", None),
    (151_955_000, "Purple Dot", None),
    (154_515_000, "Brown Dot (VHF)", None),
    (154_540_000, "Yellow Dot (VHF)", None),
    (158_400_000, "Itinerant 158.400", None),
    (451_800_000, "Itinerant 451.800", 5 * MHZ),
    (451_812_500, "Itinerant 451.8125", 5 * MHZ),
    (456_800_000, "Itinerant 456.800 (input)", None),
    (456_812_500, "Itinerant 456.8125 (input)", None),
    (464_500_000, "Brown Dot (UHF)", 5 * MHZ),
    (464_550_000, "Yellow Dot (UHF)", 5 * MHZ),
    (467_762_500, "J Dot", None),
    (467_812_500, "K Dot", None),
    (467_850_000, "Silver Star", None),
    (467_875_000, "Gold Star", None),
    (467_900_000, "Red Star", None),
    (467_925_000, "Blue Star", None),
    (469_500_000, "Itinerant 469.500", None),
    (469_550_000, "Itinerant 469.550", None),
)
#: Segments: service, kHz from, kHz to, label, offset Hz where the segment holds repeater outputs.
SEGMENTS = (
    ("ham2m", 144_000, 144_050, "2 m EME (CW)", None),
    ("ham2m", 144_050, 144_100, "2 m general CW and weak signal", None),
    ("ham2m", 144_100, 144_200, "2 m EME and weak-signal SSB", None),
    ("ham2m", 144_200, 144_275, "2 m general SSB", None),
    ("ham2m", 144_275, 144_300, "2 m propagation beacons", None),
    ("ham2m", 144_300, 144_500, "2 m OSCAR subband", None),
    ("ham2m", 144_500, 144_600, "2 m linear translator inputs", None),
    ("ham2m", 144_600, 144_900, "2 m FM repeater inputs", None),
    ("ham2m", 144_900, 145_100, "2 m weak signal and FM simplex (packet 145.01–145.09)", None),
    ("ham2m", 145_100, 145_200, "2 m linear translator outputs", None),
    ("ham2m", 145_200, 145_500, "2 m FM repeater outputs", 600 * KHZ),
    ("ham2m", 145_500, 145_800, "2 m miscellaneous and experimental", None),
    ("ham2m", 145_800, 146_000, "2 m OSCAR subband", None),
    ("ham2m", 146_010, 146_370, "2 m repeater inputs", None),
    ("ham2m", 146_400, 146_580, "2 m simplex", None),
    ("ham2m", 146_610, 146_970, "2 m repeater outputs", 600 * KHZ),
    ("ham2m", 147_000, 147_390, "2 m repeater outputs", 600 * KHZ),
    ("ham2m", 147_420, 147_570, "2 m simplex", None),
    ("ham2m", 147_600, 147_990, "2 m repeater inputs", None),
    ("ham70cm", 420_000, 426_000, "70 cm ATV repeater or simplex", None),
    ("ham70cm", 426_000, 432_000, "70 cm ATV simplex", None),
    ("ham70cm", 432_000, 432_070, "70 cm EME", None),
    ("ham70cm", 432_070, 432_100, "70 cm weak-signal CW", None),
    ("ham70cm", 432_100, 432_300, "70 cm mixed-mode and weak signal", None),
    ("ham70cm", 432_300, 432_400, "70 cm propagation beacons", None),
    ("ham70cm", 432_400, 433_000, "70 cm mixed-mode and weak signal", None),
    ("ham70cm", 433_000, 435_000, "70 cm auxiliary and repeater links", None),
    ("ham70cm", 435_000, 438_000, "70 cm satellite only", None),
    ("ham70cm", 438_000, 444_000, "70 cm ATV repeater input and repeater links", None),
    ("ham70cm", 442_000, 445_000, "70 cm repeater inputs and outputs (local option)", 5 * MHZ),
    ("ham70cm", 445_000, 447_000, "70 cm links, repeaters and simplex (local option)", None),
    ("ham70cm", 447_000, 450_000, "70 cm repeater inputs and outputs (local option)", 5 * MHZ),
)
#: Channels with a window of their own, 10 kHz to each side.
CALLING = (
    ("ham2m", 146_520_000, "2 m national FM simplex calling", "146.52 — the one everyone monitors"),
    ("ham2m", 144_390_000, "APRS (North America)", "packet, not voice"),
    ("ham2m", 144_200_000, "2 m national SSB calling", None),
    ("ham70cm", 446_000_000, "70 cm national FM simplex calling", "446.000"),
    ("ham70cm", 432_100_000, "70 cm calling frequency", "SSB/CW"),
)
OFFSET_NOTES = {600 * KHZ: "600 kHz standard offset", 5 * MHZ: "5 MHz standard offset"}

NOMINAL = "service string, label string, channel_number string, center long, bandwidth long, is_repeater_out int, pair_offset_hz long, licensed int, source string, notes string"
RANGES = "service string, label string, freq_lo_hz long, freq_hi_hz long, freq_center_hz long, bandwidth_hz long, kind string, is_repeater_out int, pair_offset_hz long, licensed int, source string, notes string"


def nominal_rows() -> list[tuple]:
    rows = [(service, f"{name} {n}", str(n), hz + (n - a) * 25 * KHZ, bw, 0, None, lic, src, notes) for service, name, a, b, hz, bw, lic, src, notes in RUNS for n in range(a, b + 1)]
    for n in range(GMRS_FIRST[0], GMRS_FIRST[1] + 1):
        hz = GMRS_HZ + (n - GMRS_FIRST[0]) * 25 * KHZ
        rows.append(("gmrs", f"GMRS {n}", str(n), hz, 20_000, 1, GMRS_OFFSET, 1, "FCC 95E", GMRS_NOTES.get(hz, GMRS_NOTE)))
        rows.append(("gmrs", f"GMRS {n} repeater input", f"{n}R", hz + GMRS_OFFSET, 20_000, 0, None, 1, "FCC 95E", "50 W, repeater input only"))
    rows += [("murs", label, None, hz, width, 0, None, 0, "FCC 95J", note) for hz, label, width, note in MURS]
    return rows + [("part90", label, None, hz, 12_500, int(off is not None), off, 1, "Part 90 itinerant", "licence required, no coordination") for hz, label, off in ITINERANT]


def range_rows() -> list[tuple]:
    rows = [(s, label, lo * KHZ, hi * KHZ, None, None, "segment", int(off is not None), off, 1, "ARRL", OFFSET_NOTES.get(off)) for s, lo, hi, label, off in SEGMENTS]
    return rows + [(s, label, hz - 10_000, hz + 10_000, hz, 20_000, "channel", 0, None, 1, "ARRL", note) for s, hz, label, note in CALLING]


def seeded(spark: SparkSession) -> DataFrame:
    """117 rows of the band plan, ids in order of (service, lo, label)."""
    nominal = spark.createDataFrame(nominal_rows(), NOMINAL)
    windows = bandplan.nominal_windows(nominal.select("service", "center", "bandwidth")).select("service", "center", F.col("lo").alias("freq_lo_hz"), F.col("hi").alias("freq_hi_hz"))
    channels = nominal.join(windows, ["service", "center"]).withColumn("kind", F.lit("channel")).withColumnsRenamed({"center": "freq_center_hz", "bandwidth": "bandwidth_hz"})
    plan = channels.unionByName(spark.createDataFrame(range_rows(), RANGES), allowMissingColumns=True)
    from pyspark.sql import Window

    return plan.withColumn("id", F.row_number().over(Window.orderBy("service", "freq_lo_hz", "label")).cast("long"))  # a table of fixed size
