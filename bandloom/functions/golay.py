"""The (23,12) Golay code and the squelch words made from it, as column expressions."""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The generator polynomial and the triple of bits above each code.
POLY, TRIPLE = 0xC75, 0b100
#: The standard codes, three octal digits each.
CODES = (
    "006", "007", "015", "017", "021", "023", "025", "026", "031", "032", "036", "043", "047", "050", "051", "053", "054", "065", "071", "072", "073", "074",
    "114", "115", "116", "122", "125", "131", "132", "134", "141", "143", "145", "152", "155", "156", "162", "165", "172", "174",
    "205", "212", "214", "223", "225", "226", "243", "244", "245", "246", "251", "252", "255", "261", "263", "265", "266", "271", "274",
    "306", "311", "315", "325", "331", "332", "343", "346", "351", "356", "364", "365", "371",
    "411", "412", "413", "423", "431", "432", "445", "446", "452", "454", "455", "462", "464", "465", "466",
    "503", "506", "516", "523", "526", "532", "546", "565",
    "606", "612", "624", "627", "631", "632", "654", "662", "664",
    "703", "712", "723", "731", "732", "734", "743", "754",
)


def remainder(word: Column) -> Column:
    """What 23 bits leave when divided by the polynomial, bit by bit from the top."""

    def step(v: Column, i: Column) -> Column:
        return F.when(F.getbit(v, i) == 1, v.bitwiseXOR(F.call_function("shiftleft", F.lit(POLY).cast("long"), (i - 11).cast("int")))).otherwise(v)

    return F.aggregate(F.sequence(F.lit(22), F.lit(11), F.lit(-1)), word.cast("long"), step).bitwiseAND(0x7FF)


def encoded(data: Column) -> Column:
    """12 bits with their 11 parity bits."""
    high = F.shiftleft(data.cast("long"), 11)
    return high.bitwiseOR(remainder(high))


def squelch_word(code: Column) -> Column:
    """The word of a code given as three octal digits in text."""
    return encoded(F.conv(code, 8, 10).cast("long") + (TRIPLE << 9))


def octal(value: Column) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 8), 3, "0")


def bits(word: Column, inverted: bool = False) -> Column:
    """Lowest bit first; inverted for the other polarity."""
    return F.transform(F.sequence(F.lit(0), F.lit(22)), lambda i: (F.getbit(word, i) if not inverted else 1 - F.getbit(word, i)).cast("int"))


def leaves(v: int) -> int:
    """What a plain number of 23 bits leaves when divided by the polynomial."""
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= POLY << (i - 11)
    return v


def plain_word(code: str) -> int:
    """The word of a code, as a plain number."""
    high = (TRIPLE << 9 | int(code, 8)) << 11
    return high | leaves(high)


@cache
def syndromes() -> dict[int, int]:
    """Error pattern of each of the 2,048 remainders; up to three flipped bits."""
    return {leaves(e): e for k in range(4) for e in (sum(1 << b for b in bs) for bs in combinations(range(23), k))}


def syndrome_table(spark: SparkSession) -> DataFrame:
    """(syndrome, error): 2,048 rows."""
    return spark.createDataFrame(list(syndromes().items()), "syndrome long, error long")


def decoded(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with data (12 bits), errors corrected, and the code where it is a standard one."""
    table = F.broadcast(syndrome_table(words.sparkSession))  # 2,048 rows, fixed by the code
    found = words.withColumn("syndrome", remainder(F.col(column))).join(table, "syndrome")
    fixed = found.withColumn("_w", F.col(column).bitwiseXOR(F.col("error"))).withColumn("data", F.shiftright("_w", 11)).withColumn("errors", F.bit_count("error"))
    code = octal(F.col("data").bitwiseAND(0x1FF))
    legal = (F.shiftright("data", 9) == TRIPLE) & code.isin(*CODES)
    return fixed.withColumn("code", F.when(legal, code)).drop("syndrome", "error", "_w")


def rotated(word: Column, k: Column) -> Column:
    """23 bits turned right by k."""
    down, up = F.call_function("shiftright", word, k), F.call_function("shiftleft", word, (23 - k).cast("int"))
    return down.bitwiseOR(up).bitwiseAND((1 << 23) - 1)


def inverse_pairs(spark: SparkSession) -> DataFrame:
    """(code, reads_as): standard codes whose word, turned and inverted, is another code's word."""
    words = spark.createDataFrame([(c,) for c in CODES], "code string").withColumn("word", squelch_word(F.col("code")))
    turned = words.select("code", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("k"), F.col("word").alias("_w"))
    turned = turned.select("code", rotated((F.lit((1 << 23) - 1) - F.col("_w")), F.col("k")).alias("word"))
    return turned.join(words.select(F.col("code").alias("reads_as"), "word"), "word").select("code", "reads_as").distinct()
