import math
import random
import re
import string

import numpy as np
import pytest

from brisa.llm import lexical
from brisa.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    """Every document scored for every item, as stated."""
    texts = [(i, words(t)) for i, t in docs]
    number = sum(bool(w) for _, w in texts)
    total = sum(len(w) for _, w in texts)
    sets = [set(w) for _, w in texts]
    rows = []
    for item, text in items:
        scored = []
        for (doc, held), there in zip(texts, sets):
            score = 0
            for term in set(words(text)) & there:
                df = sum(term in s for s in sets)
                weight = math.floor(1000 * math.log((2 * number + 2) / (2 * df + 1)))
                tf, m = held.count(term), 10 + 90 * len(held) * number // total
                score += weight * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, -math.inf if doc is None else doc, doc))
        rows += [(item, n, doc, -score) for n, (score, _, doc) in enumerate(sorted(scored, key=lambda s: s[:2])[:k], 1)]
    return sorted(rows, key=repr)


def found(docs, items, k):
    rows = lexical.search(docs, items, k).collect()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows], key=repr)


ITEMS = [(1, "abc Ab É x1 déjà"), (2, "..."), (3, None), (4, ""), (None, "ÀB ab cc"), (5, "b b a c"), (5, "b b a c"), (6, "nowhere")]


@pytest.fixture(params=[(1 << 15, 64), (7, 1), (40, 3)])
def sizes(request, monkeypatch):
    """Shards and blocks of several sizes."""
    monkeypatch.setattr(lexical, "SHARD", request.param[0])
    monkeypatch.setattr(lexical, "BLOCK", request.param[1])


def test_equals_brute_force(spark, frame, sizes):
    r = random.Random(4)
    letters = ["a", "b", "c", "ab", "AB", "abc", "É", "é", "x1", "déjà", "cc", "zz"]
    docs = [(i, " -".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for i in range(150)]
    docs += [(7, "ab abc"), (7, "ab abc"), (None, "abc x1"), (None, None), (901, ""), (902, "\n !"), (903, "b " * 5000), (904, "ab abc")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for k in (1, 3, 10, 500):
        assert found(frame(docs), items, k) == brute(docs, ITEMS, k)


def test_odd_rows_and_blocks_of_items(spark, odd, given, none, monkeypatch):
    items = [(i, t[:300]) for i, t, _ in given if t] + ITEMS
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(i, t) for i, t, _ in given]
    want = brute(docs, items, 5)
    assert found(odd, frame, 5) == want
    monkeypatch.setattr(lexical, "ITEM_CHARS", 500)
    assert found(odd, frame, 5) == want
    assert lexical.search(none, frame).count() == 0
    assert lexical.search(odd, frame.where("false")).count() == 0


def test_reading_stops_before_the_ends_of_the_lists():
    r = np.random.default_rng(1)
    terms, counts = np.tile(np.arange(3), 4000), r.integers(1, 50, 12000)
    n = r.integers(1, 5000, 4000)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return super().__getitem__(key)

    lists = lexical.Lists(np.arange(4000), n, terms, counts, np.full(4000, 3), 4000, int(n.sum()), np.array([9000, 40, 1]))
    ids, scores = lists.best(np.arange(3), 10, 1)
    total = np.zeros(4000, np.int64)
    np.add.at(total, lists.document, lists.impact)
    order = np.lexsort((np.arange(4000), -total))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    lists.impact = lists.impact.view(Counted)
    lists.best(np.arange(1), 10, 1)
    assert sum(read) < 1000


def test_query_on_a_given_table(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as base:
        docs = base.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
        items = base.execute(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
    rows = [tuple(r) for r in QUERIES["op13_lexical_search"](spark, folder).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(rows, key=repr) == brute(docs, items, 10)
