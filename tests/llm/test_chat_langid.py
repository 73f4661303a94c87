"""Chat formatting: exact round trips; language identification: held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from bandloom.llm import chat, langid

BITS = ["</s>", "[INST]", "[/INST]", "<s>", "<|im_start|>", "<|im_end|>", "\\", "\n", "<", "[", "é", "𝔸", " ok ", "<<SYS>>", "\\n", "n", ""]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_escapes_are_reversible_and_hide_control_strings():
    for t in texts(1, 4000):
        assert chat.unescape(chat.escape(t)) == t and chat.unescape(chat.escape(t, True), True) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL) and "\n" not in chat.escape(t, True)


def test_digests_equal_the_turns(spark):
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant", "sys\ntem", None]), t if rng.random() > 0.1 else None) for c in range(60) for k, t in enumerate(texts(c, rng.randint(1, 9)))]
    rows += [(99, k, "assistant" if k % 2 else "user", f"{k}</s>") for k in range(500)]  # longer than any window
    rows += [(5, 2, "assistant", "same turn"), (5, 2, "assistant", "same turn"), (7, None, "user", "null turn"), (None, 1, "assistant", "no conv")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    by = {}
    for c, k, role, t in rows:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        r = got[c]
        assert r.n_turns == len(turns) and r.rewrites == 0
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(t for a, t in turns if a == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.chatml(turns))
    spans = chat.turn_spans(df.where("conv_id = 99")).orderBy("turn_no").collect()
    assert "".join(s.piece for s in spans) == chat.chatml([(r, t) for _, _, r, t in sorted(by[99])])
    assert chat.digests(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")

    def drops_old(turns):  # shows the assistant's thoughts in the last turn only
        return "".join(f"<{r}>{t}{'(thinking)' if k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))

    assert [r.rewrites for r in chat.digests(df, drops_old).collect()] == [2]


def test_black_box_templates_see_every_turn_from_the_first(spark):
    said = [("assistant" if k % 2 else "user", f"turn {k}</s>") for k in range(200)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string").repartition(3)

    def begins(turns):
        return "<bos>system\n" + "".join(f"<{r}>{t}\n" for r, t in turns)

    def numbers(turns):
        return "".join(f"{k}. <{r}>{t}\n" for k, (r, t) in enumerate(turns))

    def strict(turns):
        if turns[0][1] not in ("turn 0</s>", *chat.PROBES):
            raise ValueError("the first turn is missing")
        return begins(turns)

    for template in (begins, numbers, strict):
        *spans, end = chat.turn_spans(df, template).orderBy(F.col("turn_no").asc_nulls_last()).collect()
        assert end.rewrites == 0 and "".join(s.piece for s in spans) == template(said)
        assert [(s.role, s.piece[s.text_start : s.text_end]) for s in spans] == said

    def forgets(turns):  # a long conversation loses the text of its first turn
        return "".join(f"<{r}>{'' if k == 0 and len(turns) > 150 else t}\n" for k, (r, t) in enumerate(turns))

    assert [r.rewrites for r in chat.digests(df, forgets).collect()] == [1]


@pytest.mark.parametrize("turns", [10, 500])
def test_templates_with_their_own_reader(spark, turns):
    said = [("assistant" if k % 2 else "user", f"turn {k} <<{k % 3}>>") for k in range(turns)]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string").repartition(3)

    def begins(turns):
        return "<bos>You are helpful.\n" + "".join(f"[{r}]{t.replace('<', '<<')}\n" for r, t in turns)

    def late(turns):  # from the ninth turn on the first one is shown in short
        return begins([(turns[0][0], "short"), *turns[1:]] if len(turns) > 8 else turns)

    def read(piece):
        return [(m[1], m[2].replace("<<", "<")) for m in re.finditer(r"\[(user|assistant)\]([^\n]*)\n", piece)]

    def plain(text):
        return text.replace("<<", "<")

    r = chat.digests(df, begins, read=read, plain=plain).first()
    loss = "".join(t for a, t in said if a == "assistant")
    assert r.n_turns == turns and r.rewrites == 0 and r.formatted_chars == len(begins(said))
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(df, late, read=read, plain=plain).first().rewrites == 1


def language_brute(docs, content):
    """Compressed sizes of the normalised text's blocks, one compressor a language and text, nothing shared between calls."""
    order = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 4}
    out = {}
    for i, t in docs:
        if t is None or not re.search(r"[^\W\d_]", t):
            out[i] = ("und", 0.0)
            continue
        words = []
        for w in re.split(r"[\W\d_]+", t.lower()):
            if w and w not in words:
                words.append(w)
        data = " ".join(words).encode()
        size = {}
        for lang, d in content.items():
            params = zstandard.ZstdCompressionParameters(**order, write_content_size=False, write_checksum=False, write_dict_id=False)
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            size[lang] = sum(len(c.compress(data[k : k + 4096])) for k in range(0, len(data), 4096))
        first, *rest = sorted(content, key=lambda x: (size[x], list(content).index(x)))
        out[i] = (first, (size[rest[0]] - size[first]) / size[rest[0]] if rest else 1.0)
    return out


def test_language_equals_brute_force(spark, small_docs, odd_docs):
    docs = small_docs.select("doc_id", "text", "lang").where("doc_id % 2 = 0").union(odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 1000000", "text", "lang"))
    content = langid.dictionaries(small_docs)
    want = language_brute([(r.doc_id, r.text) for r in docs.collect()], content)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, content, ["doc_id"]).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - s) < 0.02 for i, (_, s) in want.items())


def test_language_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = langid.op3_language(spark, d).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ties_go_to_the_larger_language(spark):
    df = spark.createDataFrame([(k, "one two three four", "zz" if k % 3 else "aa") for k in range(30)] + [(99, "½ 12", "aa")], "doc_id long, text string, lang string")
    content = langid.dictionaries(df)
    assert list(content) == ["zz", "aa"]
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, {k: b"" for k in content}, ["doc_id"]).collect()} == {k: "zz" for k in range(30)} | {99: "und"}


@pytest.mark.parametrize("ids", ["null", "7", "id % 2", "id"])
def test_every_language_has_a_dictionary_whatever_the_ids(spark, ids):
    """Ten languages, one of a single text a thousand times over, and ids that say nothing."""
    df = spark.range(4000).selectExpr(f"cast({ids} AS long) AS doc_id", "concat('l', id % 10) AS lang", "if(id % 10 = 3, 'always the same', concat('tongue', substring(translate(md5(cast(id AS string)), '0123456789', 'ghijklmnop'), 1, 20), ' l', id % 10)) AS text")
    content = langid.dictionaries(df)
    assert sorted(content) == [f"l{k}" for k in range(10)] and content["l3"] == b"\nalways the same"
    assert all(c.count(b"\n") in (1, 200) for c in content.values()) and {r.lang_pred for r in langid.predict(df, content, ["lang"]).where("lang = 'l3'").collect()} == {"l3"}


def test_language_odd_tables(spark, odd_docs, empty_docs):
    content = langid.dictionaries(odd_docs)
    assert sorted(content) == ["de", "en"]
    out = langid.predict(odd_docs, content, ["doc_id", "text", "kept"]).collect()
    assert len(out) == odd_docs.count()
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in out)
    assert {r.lang_pred for r in langid.predict(odd_docs, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.dictionaries(empty_docs) == {} and langid.predict(empty_docs, content, ["doc_id"]).count() == 0
