import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brisa.llm import packing
from brisa.llm.queries import vocabulary
from brisa.llm.ranks import ranked
from brisa.llm.tokens import token_ids

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizer(tokenizer, given):
    texts = [t or "" for _, t, _ in given]
    texts += [" ", "  ", "a  b", "a\n b", "a \nb", "a\n \nb", "don't we're 's x", "\n\n\n", "漢字 かな 😀", "tab\tx  y"]
    texts += ["<|endoftext|> a", "x  y  z", "１２ ² ½", "a​b", "\x1c \x1d a\x85b", "x 　　y", "'ve 're'll"]
    for text, ids in zip(texts, token_ids(pa.array(texts), PATH)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:40])


@pytest.fixture(scope="module")
def loaded():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


END = "<|endoftext|>"
HOLDING = [
    END, f"a {END} b", f"a{END}b", f"a  {END}  b", f"{END}{END}", f"\n\n{END}\n", f"don{END}'t", f"<{END}>", END[:-1] + " " + END,
    f"1{END}２ 漢{END}字", END.upper(), "x <|endoftext |> y", f"a  b {END} c", f" {END} ",
]


def test_added_tokens_are_those_of_the_tokenizer_as_loaded(loaded, given):
    texts = HOLDING + [t or "" for _, t, _ in given] + ["a  b", "a\n b", "x \u3000\u3000y", "'ve 're'll"]
    assert loaded.encode(f"a {END} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for text, ids in zip(texts, token_ids(pa.array(texts), vocabulary())):
        assert ids.tolist() == loaded.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_pieces_of_texts_with_added_tokens(frame, loaded):
    texts = [f"{t} " * 40 for t in HOLDING]
    rows = packing.packed(frame(list(enumerate(texts))), vocabulary(), 64, 2).collect()
    want = []
    for i, text in enumerate(texts):
        ids = np.array(loaded.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(at, at[1:])]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_odd_rows(odd, given, tokenizer):
    rows = packing.packed(odd, PATH, 64, 2).collect()
    want = []
    for id_, text, _ in given:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 64 or 64
        at = [0, *range(min(first, len(ids)), len(ids) + 1, 64)]
        want += [(id_, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(at, at[1:]))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table(none):
    assert packing.packed(none, PATH).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits, default=capacity)
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_one_by_one(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 400) if seed % 2 else np.minimum(100, r.geometric(0.1, 400))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    planned = packing.plan(counts, 100)
    rooms = sorted(100 - sum(held) for n, held in planned for _ in range(n))
    assert rooms == best_fit(lengths.tolist(), 100)
    slots = packing.slots(planned)
    assert {n: sum(h - low for k, low, h, _, _ in slots if k == n) for n in counts} == counts


def test_ranks_of_a_hot_group(spark):
    rows = [(1 if i % 3 else None, i * 7919 % 1000) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k int, v int").repartition(5)
    found = {(r["k"], r["v"]): r["n"] for r in ranked(frame, "k", ["v"], "n").collect()}
    for k in (1, None):
        values = sorted(v for key, v in rows if key == k)
        assert [found[k, v] for v in values] == list(range(len(values)))
