from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = ["the", "of", "ner", "è", "Straße", "señor", "a", "xx", "tho", "ou", "token:", "and", "𝔸b", "re", "st"]


def odd_texts() -> list[str | None]:
    """Null, empty, blank, tiny, repeated, very long and random texts."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    lines = ["\n".join(rng.choice(["", " ", "same line here", "other é line", "x"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    return [None, "", " ", "\n\n", "a", "é", "a b", "  lead and trail  ", "tab\tvt\x0bff\x0ccr\rend", "word " * 30_000, "x" * 200_000, "none space here", *prose, *prose[:5], *lines]


@pytest.fixture(scope="session")
def odd_docs(spark):
    texts = odd_texts()
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "ü"][i % 4], "clash", i % 2) for i, t in enumerate(texts)]
    rows += [(None, "null id text with words", "en", "a", "clash", 1), *rows[12:15]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, size long").repartition(5).cache()


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where(F.lit(False))


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
