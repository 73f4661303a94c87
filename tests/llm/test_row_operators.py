"""Operators that judge one text at a time, against plain brute force over the same rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from bandloom.llm import pii, quality, secrets

SP = "\x20\x09-\x0D"
FRAGMENTS = ["a", "b@c.de", "a.b_c@x-y.com", "é", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (743) 555-3824", "+49", " ", ".", "-", "@", "_", "%", "12", "0", "+", "\n", "𝔸", "007.1.2.3",
             "secret=", "Token : ", "api_key='", "PASSWD:", "abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", '"', "ghp_" + "a1B2" * 10, "xoxb-1234567890-ab"]


def fuzz(spark, n=1500):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 16)))) for i in range(n)]
    rows += [(n, None), (n + 1, "1 " * 50_000), (n + 2, "a." * 50_000 + "@" + "b.c" * 20_000), (n + 3, "f" * 100_000), (n + 4, "ſecret=abcdefgh")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def pii_brute(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if len(t) < 90_000 else "")]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] if 16 <= len(d) <= 19 and luhn(d) else []
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_brute_force(spark, small_docs):
    rows, df = fuzz(spark)
    rows = rows + [(r[0] + 10**6, r[1]) for r in small_docs.select("doc_id", "text").collect()]
    df = df.union(small_docs.selectExpr("doc_id + 1000000", "text"))
    got = {r[0]: r[1] for r in pii.find(df).select("doc_id", "pii").collect()}
    for i, t in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in ("email", "ip", "card", "phone")]
        if t is None or len(t) < 90_000:
            assert base == pii_brute(t), t
        for s in got[i]:
            assert t[s["start"] : s["end"]] == s["value"]


def test_pii_iban_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "my iban GB82WEST12345698765432 or GB82WEST12345698765433, mail a@b.co"), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r.pii for r in pii.find(df).collect()}
    assert [(s["kind"], s["score"]) for s in found[1] if s["kind"] == "iban"] == [("iban", 1.0)]
    assert found[2] == [] and found[3] == []
    red = {r.doc_id: r.text for r in pii.redact(df).select("doc_id", "text").collect()}
    assert red[1] == "my iban [iban] or GB82WEST12345698765433, mail [email]" and red[2] is None


def extra_brute(t):
    """The kinds beyond the base: (kind, start, end, score in per cent), from plain checks."""
    digits = lambda v: [int(c) for c in v]

    def iban(v):
        v = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    kinds = (
        ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", iban, 70, "iban bank account konto bankverbindung cuenta banco compte banque transfer swift bic"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000", 50, "ssn social security taxpayer"),
        ("aba", r"[0-9]{9}", lambda v: int(v) > 0 and sum(d * (3, 7, 1)[k % 3] for k, d in enumerate(digits(v))) % 10 == 0, 40, "routing aba rtn transit bank wire"),
        ("dni", r"[0-9]{8}[A-Z]", lambda v: "TRWAGMYFPDXBNJZSQVHLCKE"[int(v[:8]) % 23] == v[8], 50, "dni nif nie identidad identificacion identificación identity"),
        ("imei", r"[0-9]{15}", luhn, 40, "imei device handset mobile gerat gerät dispositivo telephone téléphone appareil"),
    )
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for kind, pattern, good, prior, words in kinds:
        for m in re.finditer(pattern, t):
            a, b = m.span()
            if not re.search("[A-Za-z0-9]", t[max(a - 1, 0) : a] + t[b : b + 1]) and good(m[0]):
                rest = (t[:a] + "\n" + t[b:]).translate(lower)
                near = [w for w in re.finditer(r"[a-z\x80-\U0010ffff]+", rest) if w[0] in words.split() and w.start() >= a - 40 and w.end() <= a + 1 + 40]
                score = prior + 30 * bool(near)
                out += [(kind, a, b, score)] if score >= 60 else []
    return out


SENTENCES = [
    ("aba", "Please wire it, our routing number is 021000021."), ("aba", "ABA 021000021 at the bank"), ("dni", "Su DNI: 12345678Z, gracias"), ("dni", "tarjeta de identidad 12345678Z"), ("imei", "the handset 490154203237518 was lost"),
    ("imei", "Gerät 490154203237518 gesperrt"), ("ssn", "Social security 078-05-1120"), ("ssn", "SSN=078-05-1120"), ("iban", "Bankverbindung DE89 3704 0044 0532 0130 00"), ("iban", "compte GB82WEST12345698765432"), ("imei", "l'appareil 490154203237518 est neuf"),
    (None, "after midnight 12345678Z came up"), (None, "database 021000021 rows"), (None, "on the embankment at 021000021"), (None, "invoice 021000021 for part 12345678Z"), (None, "antisocial 078-05-1120"), (None, "order 490154203237518"),
    (None, "devices 490154203237518"), (None, "routings 021000021"), (None, "éaba 021000021"), (None, "bank routing 021000022"), (None, "DNI 12345678A"), (None, "iban GB82WEST12345698765433"),
]


def test_pii_precision_and_recall_of_labelled_sentences(spark):
    df = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(SENTENCES)], "doc_id long, text string")
    found = {r.doc_id: [s["kind"] for s in r.pii if s["kind"] in ("aba", "dni", "imei", "ssn", "iban")] for r in pii.find(df).collect()}
    assert {SENTENCES[k][1]: v for k, v in found.items()} == {s: [kind] if kind else [] for kind, s in SENTENCES}


def test_pii_words_against_a_kind_lower_its_score(spark):
    card = "4111 1111 1111 1111"
    df = spark.createDataFrame([(1, f"tracking {card}"), (2, f"visa {card}"), (3, card), (4, f"visa card, invoice {card}"), (5, f"backtracking {card}"), (6, "version 1.2.3.4"), (7, "the server at 1.2.3.4")], "doc_id long, text string")
    got = {r.doc_id: round(100 * r.pii[0]["score"]) for r in pii.find(df).collect()}
    assert got == {1: 50, 2: 100, 3: 80, 4: 100, 5: 80, 6: 30, 7: 90}


def test_pii_context_decides(spark):
    rng = random.Random(11)
    parts = ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765433", "ES91 2100 0418 4502 0005 1332", "078-05-1120", "666-05-1120", "078-05-11201", "021000021", "021000022", "12345678Z", "12345678A", "490154203237518",
             "490154203237519", "SSN ", "social ", "iban ", "bank routing ", "DNI: ", "imei=", "device ", " and ", "x", " . ", "-", " lorem ipsum dolor sit amet consectetur adipiscing ", "é𝔸 "]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 12)))) for k in range(1500)]
    got = {r.doc_id: r.pii for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    met = Counter()
    for i, t in rows:
        extra = [(s["kind"], s["start"], s["end"], round(100 * s["score"])) for s in got[i] if s["kind"] not in ("email", "ip", "card", "phone")]
        assert extra == extra_brute(t), t
        met.update((k, s >= 80) for k, _, _, s in extra)
    assert {k for k, _ in met} == {"iban", "ssn", "aba", "dni", "imei"}


def secret_brute(t):
    t = t or ""
    kinds = {
        "assign": [m for m in re.finditer(r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6 and m[1].isascii()],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24],
    }
    spans = sorted((m.start(), k, kind, m.end()) for k, (kind, ms) in enumerate(kinds.items()) for m in ms)
    return {k: len(v) for k, v in kinds.items()}, ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def test_secrets_equal_brute_force_and_ledger_is_incremental(spark, small_docs, tmp_path):
    rows, df = fuzz(spark)
    rows = rows + [(r[0] + 10**6, r[1]) for r in small_docs.select("doc_id", "text").collect()]
    df = df.union(small_docs.selectExpr("doc_id + 1000000", "text"))
    ledger = f"file://{tmp_path}/ledger"
    first = {r.doc_id: r for r in secrets.scan_history(df.where("doc_id < 800"), ledger).collect()}
    seen = spark.read.parquet(ledger).count()
    got = {r.doc_id: r for r in secrets.scan_history(df, ledger).collect()}
    led = spark.read.parquet(ledger)
    assert len(first) == 800 and len(got) == len(rows)
    assert seen < led.count() == led.select("blob").distinct().count()
    for i, t in rows:
        counts, line = secret_brute(t)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts.values()), t
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    again = secrets.scan_history(df, ledger).count()
    assert again == len(rows) and spark.read.parquet(ledger).count() == led.count()


def test_secrets_odd_tables(odd_docs, empty_docs, tmp_path):
    assert secrets.scan_history(odd_docs, f"file://{tmp_path}/a").count() == odd_docs.count()
    assert secrets.scan_history(empty_docs, f"file://{tmp_path}/b").count() == 0
    assert pii.find(empty_docs).count() == 0 and pii.find(odd_docs).count() == odd_docs.count()


def quality_brute(t):
    t = t or ""
    w = re.findall(f"[^{SP}]+", t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(f"[^{SP}]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_measures_equal_brute_force(odd_docs, small_docs, empty_docs):
    docs = small_docs.select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 1000000", "text"))
    out = quality.cascade(docs, measure_all=True).collect()
    assert len(out) == docs.count()
    for r in out:
        want = quality_brute(r.text)
        assert tuple(r[k] for k in quality.REPORTED) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and r.kept == (r.rejected_by is None)
    assert quality.cascade(empty_docs).count() == 0


def test_quality_short_circuit_gives_the_same_verdict(odd_docs):
    full = {(r.doc_id, r.text): r.kept for r in quality.cascade(odd_docs, ["doc_id", "text"], measure_all=True).collect()}
    kept = quality.cascade(odd_docs, ["doc_id", "text", "source"], only_kept=True).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(str(k) for k, v in full.items() for _ in range(sum((r.doc_id, r.text) == k for r in kept)) if v)
    assert {(r.doc_id, r.text) for r in kept} == {k for k, v in full.items() if v}


def test_rule_order_puts_rejections_per_cost_first():
    cheap = [b"x y"] * 50 + [b"the quick brown fox jumps over it " * 40] * 50
    assert quality.rule_order(cheap)[0] in ("few_words", "repeated_words")
    assert quality.rule_order([]) == [r.name for r in quality.RULES]
