"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression; a text never leaves its row. Positions come from the
pieces between matches: ``split`` and ``regexp_extract_all`` walk the same matches, so the
lengths of pieces and matches, summed in turn, give each start. Every repeated group in a
pattern is possessive, and a run of word characters is entered at its start only (or where
the last match ended, ``\\G``), so long runs cost linear time and no stack.

Kinds: email, ip, card (Luhn) and phone as fixed by their patterns, which are always kept; and
iban (mod 97, in one piece or in groups of four), ssn (parts in range), aba (weights 3, 7, 1),
dni (letter of the remainder by 23) and imei (Luhn), which stand between characters other than
letters and digits and are kept when their score reaches ``threshold``. A score is the kind's prior, raised by BOOST where
one of its context words stands whole within ``near`` code points before or after the span, and
lowered by as much where one does that speaks against it, and none for it. An iban's checksum
suffices; the others, whose checks a number passes by chance more often, need a word. Words are
English, German, Spanish and French, in either case of a-z.

Defined results: null text has no spans; kinds may overlap each other; repeated rows are rows of
their own; an empty table gives an empty result; extra columns pass through ``find`` (a column
named ``pii`` is replaced). In capitals, a word of four letters right after a grouped iban whose
length is a multiple of four is taken for its last group, and the iban is not found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    mark: str  # a pattern-free text that every match holds, or "" for none
    prior: float
    words: str  # context words, as an alternation
    base: bool
    against: str = ""  # words that speak against it


#: The patterns, validators' limits and context words of each kind.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e-?mails?|mail|contact|write|reply|kontakt|schreiben|correo|contacto|courriel|contactez", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|ipv4|hosts?|address|server|gateway|dns|rechner|adresse|servidor|serveur|h[oô]te", True, "version|release|section|chapter|build|kapitel|cap[ií]tulo|chapitre"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", "", 0.8, "cards?|visa|mastercard|credit|debit|pay(?:ment)?|karte|kreditkarte|zahlung|tarjeta|cr[eé]dito|pago|carte|paiement", True, "tracking|serial|isbn|invoice|rechnung|factura|facture"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|telephone|call|tel|mobile|cell|fax|telefon|anrufen|handy|tel[eé]fono|m[oó]vil|llame|t[eé]l[eé]phone|appelez|portable", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "", 0.7, "iban|bank|account|konto|bankverbindung|cuenta|banco|compte|banque|transfer|swift|bic", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.5, "ssn|social|security|taxpayer", False, "isbn|order|invoice|part|phone"),
    Kind("aba", r"[0-9]{9}", "", 0.4, "routing|aba|rtn|transit|bank|wire", False, "isbn|order|invoice|tracking|ticket|phone"),
    Kind("dni", r"[0-9]{8}[A-Z]", "", 0.5, "dni|nif|nie|identidad|identificaci[oó]n|identity", False, "part|model|serial"),
    Kind("imei", r"[0-9]{15}", "", 0.4, "imei|device|handset|mobile|ger[aä]t|dispositivo|t[eé]l[eé]phone|appareil", False, "order|invoice|tracking"),
)
#: what may stand next to a context word: anything but a letter, accented ones included
APART = r"[^a-z\x{80}-\x{10FFFF}]"
BOOST, NEAR, THRESHOLD = 0.3, 40, 0.6
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ABA_WEIGHTS = (3, 7, 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY_SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Every second digit from the right doubled, nine taken off above nine; the sum ends in 0."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97_ok(value: Column) -> Column:
    """The first four characters moved to the end, letters read as 10..35: the number mod 97 is 1."""
    value = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(4)).try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits_of(value)).between(16, 19) & luhn_ok(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    if kind == "iban":
        return mod97_ok(value)
    if kind == "ssn":
        area = F.left(value, F.lit(3))
        return ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(value, 5, 2) != "00") & (F.right(value, F.lit(4)) != "0000")
    if kind == "aba":
        weighed = [F.substring(value, k + 1, 1).cast("int") * ABA_WEIGHTS[k % 3] for k in range(9)]
        return (sum(weighed[1:], weighed[0]) % 10 == 0) & (value != "000000000")
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), F.left(value, F.lit(8)).cast("int") % 23 + 1, F.lit(1)) == F.right(value, F.lit(1))
    if kind == "imei":
        return luhn_ok(value)
    return F.lit(True)


def kind_spans(text: Column, kind: Kind, near: int) -> Column:
    """Array of (kind, start, end, value, score): confirmed matches in order; offsets in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        span = F.struct(F.lit(kind.name).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), pair["value"].alias("value"), F.lit(kind.prior).alias("score"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    none = F.array().cast(EMPTY_SPANS)
    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    confirmed = F.filter(placed, lambda s: valid(kind.name, s["value"]) if kind.base else stands_alone(text, s) & valid(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        # a code point more on each side shows whether a word ends there; the text's ends count as apart
        lo = F.greatest(s["start"] - near - 1, F.lit(0))
        end = F.when(s["end"] + near >= F.length(text), "\n").otherwise("")
        around = F.concat(F.when(s["start"] <= near, "\n").otherwise(""), F.substring(text, lo + 1, s["start"] - lo), F.lit("\n"), F.substring(text, s["end"] + 1, F.lit(near + 1)), end)
        around = F.translate(around, UPPER, LOWER)
        score = F.when(around.rlike(whole(kind.words)), F.lit(raised(kind, 1)))
        if kind.against:
            score = score.when(around.rlike(whole(kind.against)), F.lit(raised(kind, -1)))
        return s.withField("score", score.otherwise(s["score"]))

    maybe = F.contains(text, F.lit(kind.mark)) if kind.mark else F.lit(True)
    return F.when(maybe & text.rlike(kind.pattern), F.transform(confirmed, scored)).otherwise(none)


def whole(words: str) -> str:
    """A pattern of any of the words standing apart."""
    return f"{APART}(?:{words}){APART}"


def raised(kind: Kind, sign: int) -> float:
    return round(min(1.0, max(0.0, kind.prior + sign * BOOST)), 2)


def stands_alone(text: Column, s: Column) -> Column:
    """Neither a letter nor a digit is next to the span."""
    before = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
    return ~F.concat(before, F.substring(text, s["end"] + 1, F.lit(1))).rlike("[A-Za-z0-9]")


def find(docs: DataFrame, near: int = NEAR, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``pii``: array of (kind, start, end, value, score), by kind as listed, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [kind_spans(text, k, near) if k.base else F.filter(kind_spans(text, k, near), lambda s: s["score"] >= threshold) for k in KINDS]
    return docs.withColumn("pii", F.concat(*parts))


def redact(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    found = find(docs, **how)
    ordered = F.array_sort(F.col("pii"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("pii") > 0, done).otherwise(text))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs).select("doc_id", "pii")
    base = [k.name for k in KINDS if k.base]

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(line(F.filter("pii", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), line(F.col("pii")).alias("spans"), scores, F.size("pii").cast("long").alias("n_spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
