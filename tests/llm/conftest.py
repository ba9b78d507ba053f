"""Fixture tables: awkward rows that every operator must take."""

import random

import pytest

WORDS = "the of and to in that is was for it with as his on be at by this had not are but from or have an they which one you were all her she there would their".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(2)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, ties."""
    rng = random.Random(11)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(w if i % 40 else f"{w}x{k}" for i, w in enumerate(words)) for k in range(6)]
    texts = [base, *near, base, None, "", " \t\n ", "one", "Ünïcode ÇA 中文 🙂 K", prose(rng, 4000), "a" * 5000, "x\ny\n\nx\nLicensed under CC BY-NC 4.0.\nAll rights\nReserved.", *(prose(rng, 60) + "." for _ in range(12))]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, (3, near[2], "en", "s0", 0), (3, near[2], "en", "s0", 0), (None, "no id at all", None, "s1", 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def odd(docs):
    """The same with further columns whose names clash with what operators make."""
    from pyspark.sql import functions as F

    names = ("n_words", "score", "row", "label", "words", "bucket", "kept", "word", "sketch", "a", "b", "key", "_w")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")
