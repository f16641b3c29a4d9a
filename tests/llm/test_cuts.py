"""Removal of repeated stretches of bytes and of words."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisa.llm import anchors, debruijn, suffix
from tests.llm.conftest import prose


def brute(items, size, rule):
    """Kept units per item; items are (id, units), ids in order."""
    seen, first = {}, {}
    for id_, units in items:
        for i in range(len(units) - size + 1):
            key = tuple(units[i : i + size])
            seen[key] = seen.get(key, 0) + 1
            first.setdefault(key, (id_, i))
    out = []
    for id_, units in items:
        gone = np.zeros(len(units), bool)
        for i in range(len(units) - size + 1):
            key = tuple(units[i : i + size])
            earlier = first[key] != (id_, i) if rule == "first" else first[key][0] != id_
            if seen[key] > 1 if rule == "other" else earlier:
                gone[i : i + size] = True
        out.append((id_, gone))
    return out


def passages(count=40):
    """Texts that share passages at changing places, some of them very common, and repeat themselves."""
    common = [prose(900 + i, 40) for i in range(4)]
    rows = []
    for i in range(count):
        parts = [prose(i, 8)]
        for j in range(1 + i % 4):
            c = common[(i + j) % 4]
            parts += [c[(i * 7) % 30 : len(c) - (i * 5) % 40], prose(1000 + 10 * i + j, 5)]
        rows.append((i, " ".join(parts)))
    rows += [(count, rows[3][1]), (count + 1, "ab" * 150), (count + 2, "x" * 100 + rows[5][1] + "y" * 90)]
    return rows


@pytest.mark.parametrize("rule", ["other", "first"])
@pytest.mark.parametrize("hot, rows", [(512, 1 << 18), (2, 1 << 18), (512, 50), (2, 1)])
def test_bytes_equal_brute_force(frame, monkeypatch, rule, hot, rows):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(anchors, "ROWS", rows)
    texts = passages()
    found = {r["doc_id"]: r["cut_"] for r in suffix.without_repeats(frame(texts), 60, rule).collect()}
    for (id_, gone), (_, text) in zip(brute([(i, t.encode()) for i, t in texts], 60, rule), texts):
        kept = bytes(np.frombuffer(text.encode(), np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (found[id_]["kept"], found[id_]["n_removed"], found[id_]["n_spans"]) == (kept, gone.sum(), runs)


@pytest.mark.parametrize("rows", [1 << 18, 50, 1])
def test_words_equal_brute_force(frame, monkeypatch, rows):
    monkeypatch.setattr(anchors, "ROWS", rows)
    texts = passages()
    found = {r["doc_id"]: r for r in debruijn.without_repeats(frame(texts), 13).collect()}
    for (id_, gone), (_, text) in zip(brute([(i, t.split()) for i, t in texts], 13, "document"), texts):
        kept = " ".join(w for w, g in zip(text.split(), gone) if not g)
        assert (found[id_]["kept"], found[id_]["n_removed"]) == (kept, gone.sum())


def test_long_texts_in_segments(frame, monkeypatch):
    monkeypatch.setattr(anchors, "SEGMENT", 700)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    monkeypatch.setattr(anchors, "kept_by_worker", lambda name, build: build())
    text = prose(1, 600)
    texts = [(1, prose(2, 300) + text), (2, text + prose(3, 200)), (3, text[100:2000])]
    found = {r["doc_id"]: r["cut_"] for r in suffix.without_repeats(frame(texts), 60, "other").collect()}
    for (id_, gone), (_, t) in zip(brute([(i, t.encode()) for i, t in texts], 60, "other"), texts):
        assert found[id_]["kept"] == bytes(np.frombuffer(t.encode(), np.uint8)[~gone])


def test_odd_rows(odd, given):
    cut = suffix.without_repeats(odd, 400, "other")
    assert cut.columns == [*odd.columns, "cut_"]
    rows = cut.collect()
    assert len(rows) == len(given)
    by_id = {r["doc_id"]: r["cut_"] for r in rows}
    for id_ in (3, 4):
        assert (by_id[id_]["n_bytes"], by_id[id_]["n_removed"], by_id[id_]["kept"]) == (0, 0, b"")
    assert by_id[9]["n_removed"] == by_id[9]["n_bytes"] > 0  # the same as 10
    assert by_id[8]["n_removed"] == 3600 and by_id[8]["kept"] == b"x"  # one letter over and over, on both sides
    assert by_id[7]["n_removed"] == 0


def test_odd_rows_by_words(odd, given):
    rows = debruijn.without_repeats(odd).collect()
    assert len(rows) == len(given)
    items = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in given if i is not None]
    want = {}
    for (id_, gone), (_, words) in zip(brute(items, 13, "document"), items):
        want[id_] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows if r["doc_id"] is not None} == want


def test_empty_tables(none):
    assert suffix.without_repeats(none).count() == 0
    assert debruijn.without_repeats(none).count() == 0


def test_whole_characters_stay_text(frame):
    shared = prose(1, 30)
    texts = [(1, "ä" + shared + "é"), (2, "Ä"[:1] + "ö" + shared + "è")]  # ends share bytes, not characters
    rows = suffix.without_repeats(frame(texts), 60, "first", characters=True).collect()
    kept = {r["doc_id"]: bytes(r["cut_"]["kept"]).decode() for r in rows}
    assert kept == {1: texts[0][1], 2: "Äöè"}


def test_suffix_classes_are_those_of_equal_prefixes():
    data = np.frombuffer((prose(1, 30) * 3).encode(), np.uint8)
    for length in (5, 8, 20, 60):
        places = np.arange(len(data) - length)
        classes = suffix.suffix_classes(data, places, length)
        parts = [data[p : p + length].tobytes() for p in places]
        order = sorted(set(parts))
        assert [order.index(p) for p in parts] == np.unique(classes, return_inverse=True)[1].tolist()


def test_digest_of_kept_bytes(frame):
    row = suffix.without_repeats(frame([(1, "abc")])).first()["cut_"]
    assert hashlib.sha256(bytes(row["kept"])).hexdigest() == hashlib.sha256(b"abc").hexdigest()


def thue_morse(size, even, odd):
    return "".join(odd if i.bit_count() % 2 else even for i in range(size))


def test_texts_that_defeat_rolling_hashes_are_not_repeats(frame):
    """Two texts without a common 400-byte string whose polynomial hashes modulo 2^64 are equal for any base."""
    draws = np.random.default_rng(0)
    draws.integers(99, 122, 64)
    for middle in (draws.integers(99, 122, 64), np.random.default_rng(0).integers(99, 122, 64), draws.integers(99, 122, 64)):
        m = bytes(middle.tolist()).decode()
        texts = [(1, thue_morse(256, "a", "b") + m + thue_morse(256, "b", "a")), (2, thue_morse(256, "b", "a") + m + thue_morse(256, "a", "b"))]
        assert not {texts[0][1][i : i + 400] for i in range(177)} & {texts[1][1][i : i + 400] for i in range(177)}
        for rule in ("other", "first"):
            found = suffix.without_repeats(frame(texts), 400, rule).collect()
            assert [r["cut_"]["n_removed"] for r in found] == [0, 0]


def test_words_that_defeat_rolling_hashes_are_not_repeats(frame):
    middle = prose(9, 40)
    texts = [
        (1, " ".join([*thue_morse(2048, "a", "b"), middle, *thue_morse(2048, "b", "a")])),
        (2, " ".join([*thue_morse(2048, "b", "a"), middle, *thue_morse(2048, "a", "b")])),
    ]
    length = 2100
    words = [t.split() for _, t in texts]
    grams = [{tuple(w[i : i + length]) for i in range(len(w) - length + 1)} for w in words]
    assert not grams[0] & grams[1]
    assert [r["n_removed"] for r in debruijn.without_repeats(frame(texts), length).collect()] == [0, 0]


def test_columns_named_as_inside(odd, given):
    names = ["spans_", "spans_of_", "cut_", "row", "doc", "start", "end", "words", "closer"]
    docs = odd.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    found = suffix.without_repeats(docs, 400, "other")
    assert found.columns == [*docs.columns, "cut__"]
    rows = found.collect()
    assert all(r[n] == n for r in rows for n in names)
    plain = suffix.without_repeats(odd.select("doc_id", "text"), 400, "other").collect()
    key = lambda r, c: (r["doc_id"] or 0, r["text"] or "", repr(r[c]))
    assert sorted(key(r, "cut__") for r in rows) == sorted(key(r, "cut_") for r in plain)
