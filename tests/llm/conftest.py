import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, start=1):
    """documents rows from texts (or (id, text) pairs)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


def plain_shingles(text, size):
    """The different shingles of a text in plain code (bytes, lower-cased in A-Z)."""
    words = text.lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, start=1: make_docs(spark, texts, start)


@pytest.fixture()
def prose():
    """Seeded made-up prose."""
    rng = random.Random(7)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()

    def make(words):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))

    make.rng = rng
    return make
