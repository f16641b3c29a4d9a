import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brisa.llm import alignment
from brisa.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Function text -> (A ids, A ends, B ids, B ends) by the tokenizers as loaded, over the whole text; None without tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in signs]
    byte = {chr(s): s for s in signs} | {chr(256 + n): s for n, s in enumerate(rest)}

    def encode(text):
        if not text:
            return None
        whole = (" " + text).encode()
        x = a.encode(" " + text, add_special_tokens=False)
        x_bytes = [bytes(byte[c] for c in t) for t in x.tokens]
        y = b.encode(text)
        y_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if b"".join(x_bytes) != whole or b"".join(y_bytes) != whole:
            return None
        return x.ids, np.cumsum([len(t) for t in x_bytes]).tolist(), y, np.cumsum([len(t) for t in y_bytes]).tolist()

    return encode


def groups_of(tokens):
    a, a_ends, b, b_ends = tokens
    out, i, k = [], 0, 0
    a_place, b_place = ({e: n for n, e in enumerate(ends)} for ends in (a_ends, b_ends))
    for end in sorted(a_place.keys() & b_place.keys()):
        j, m = a_place[end] + 1, b_place[end] + 1
        out.append((a[i:j], b[k:m]))
        i, k = j, m
    assert (i, k) == (len(a), len(b))
    return out


def brute(docs, plain):
    held = [(id_, plain(text)) for id_, text in docs]
    linked = []
    for _, tokens in held:
        linked.append(Counter((x, y) for a, b in groups_of(tokens) for x in a for y in b) if tokens else Counter())
    counts = Counter(pair for links in linked for pair in links)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for (id_, tokens), links in zip(held, linked):
        if not tokens:
            rows.append((id_, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups = groups_of(tokens)
        named = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        sha = hashlib.sha256(named.encode()).hexdigest()
        rows.append((id_, len(tokens[0]), len(tokens[2]), len(groups), sum(links.values()), best, total, sha))
    return sorted(rows, key=repr)


def found(docs):
    return sorted([tuple(r) for r in alignment.align(docs, A, B).collect()], key=repr)


TEXTS = [
    " a", "a ", "a  b", "  ", "\n a\tb", "a\r\nb c", "don't we're", "漢字 かな 😀 x", "a▁b c", "é x y", "<|endoftext|> <s> </s> <0x41> <unk>",
    "ＡＢ ①ﬁ", "x" * 300, "a▁", "▁", "0 1 2 33 444", "a\u0000b", "\x1c \x1d a\x85b", "ab " * 30 + "cd", "é ​ x", "a b　 c", " . , ;",
]


def mixed_prose(seed, words):
    r = random.Random(seed)
    letters = "abcdeéßñ漢字😀 '\n.x0"
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(words))


@pytest.fixture(params=[(1 << 15, 1 << 14, 16, 1 << 21), (100, 40, 2, 50), (0, 7, 3, 1 << 21)])
def sizes(request, monkeypatch):
    """Texts whole, in ranges composed over several levels, and in ranges of a few bytes; pairs in slices."""
    for name, value in zip(("LONG", "CHUNK", "FAN", "SLICE"), request.param):
        monkeypatch.setattr(alignment, name, value)


def test_equals_brute_force(frame, plain, sizes):
    docs = list(enumerate(TEXTS)) + [(100 + i, mixed_prose(i, 60)) for i in range(12)]
    docs += [(5, "a  b"), (None, "abc déjà"), (None, None), (300, ""), (301, "zx" * 200 + " end of it")]
    assert found(frame(docs)) == brute(docs, plain)


def test_odd_rows(odd, given, none, plain):
    docs = [(i, t) for i, t, _ in given]
    assert found(odd) == brute(docs, plain)
    assert alignment.align(none, A, B).count() == 0


def same(x, y):
    return x[:7] == y[:7] and x.pairs.tolist() == y.pairs.tolist() and x.times.tolist() == y.times.tolist()


@pytest.mark.parametrize("seed", range(20))
def test_composition_is_associative(seed, plain):
    r = random.Random(seed)
    a, a_ends, b, b_ends = plain(mixed_prose(seed, 20))
    a_ends, b_ends = np.array(a_ends), np.array(b_ends)
    cuts = sorted({0, int(a_ends[-1]), *(r.randrange(int(a_ends[-1])) for _ in range(8))})

    def part(low, high):
        (i, j), (k, m) = (np.searchsorted(e, [low, high], "right") for e in (a_ends, b_ends))
        return alignment.fragment(a[i:j], a_ends[i:j], b[k:m], b_ends[k:m])

    parts = [part(x, y) for x, y in zip(cuts, cuts[1:])]
    whole = part(0, cuts[-1])

    def any_order(parts):
        if len(parts) == 1:
            return parts[0]
        at = r.randrange(1, len(parts))
        return alignment.compose(any_order(parts[:at]), any_order(parts[at:]))

    for _ in range(5):
        assert same(any_order(parts), whole)
    assert same(alignment.composed(parts), whole)
    assert same(alignment.compose(alignment.EMPTY, whole), whole) and same(alignment.compose(whole, alignment.EMPTY), whole)


def test_query_on_a_given_table(spark, plain):
    import duckdb

    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as base:
        docs = base.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = QUERIES["op12_token_alignment"](spark, folder).select(names).collect()
    assert sorted([tuple(r) for r in rows], key=repr) == brute(docs, plain)
