import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Names that operators use inside, as further columns of the input.
CLASHING = ["doc", "block", "tail", "fingerprint", "size", "p", "rank", "g", "a", "n", "spans", "cut", "copies", "score", "_label", "id", "root"]


def prose(seed, words, letters="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text[, source]); sources go in turn."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            text = row[1]
            source = row[2] if len(row) > 2 else f"s{i % 3}"
            full.append((row[0], text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty, blank and very long texts, equal texts and equal rows, and clashing column names."""
    from pyspark.sql import functions as F

    shared = prose(1, 200)
    rows = [
        (1, shared + " " + prose(2, 80)),
        (2, prose(3, 40) + " " + shared),
        (3, None, None),
        (4, ""),
        (5, "  \n\t "),
        (6, "a"),
        (7, prose(4, 30_000)),
        (8, "é" * 900 + "x" + "é" * 900),
        (9, prose(5, 300)),
        (10, prose(5, 300)),
        (11, shared),
        (11, shared),
        (None, prose(6, 50)),
        (None, None, None),
        (12, "ab " * 400),
    ]
    docs = frame(rows)
    return docs.select("*", *[F.lit("other").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def given(odd):
    """The odd rows as Python values (doc_id, text, source), in order of id."""
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
