import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brisa.llm import token_trees as tt
from brisa.llm.queries import vocabulary
from brisa.llm.tokens import encoders
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def whole(text):
    return len(encoders(PATH)[1](text)) if text else 0


def odd_text(seed, size):
    r = random.Random(seed)
    return "".join(r.choice(["word", " ", "  ", "\n", "'re", "'", "é", "12", "!", " the", "　", "x"]) for _ in range(size))


def test_counts_follow_many_edits(monkeypatch):
    monkeypatch.setattr(tt, "LEAF", 12)
    r = random.Random(3)
    for seed in range(30):
        text = odd_text(seed, 120)
        chars, tokens = tt.build(text, PATH)
        assert tokens[1] == whole(text) and chars[1] == len(text)
        for _ in range(25):
            start, removed = r.randrange(len(text) + 1), r.choice([0, 1, 3, 40])
            inserted = odd_text(r.random(), r.choice([0, 1, 5]))
            want = text[:start] + inserted + text[min(len(text), start + removed) :]
            text, _ = tt.edit(text, chars, tokens, start, removed, inserted, PATH)
            assert text == want and tokens[1] == whole(text) and chars[1] == len(text), (seed, start, removed, inserted)
            width = len(chars) // 2
            assert all(chars[i] == chars[2 * i] + chars[2 * i + 1] for i in range(1, width))


def test_counts_follow_edits_of_added_tokens(monkeypatch):
    """Edits that make, break and move the literal of an added token, with leaves cut close to it."""
    monkeypatch.setattr(tt, "LEAF", 12)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    parts = ["word", " ", "  ", "\n", "<|endoftext|>", "<|endof", "text|>", "é", " the", "x", "|>"]
    for seed in range(20):
        text = "".join(r.choice(parts) for _ in range(120))
        chars, tokens = tt.build(text, vocabulary())
        assert tokens[1] == len(tokenizer.encode(text, add_special_tokens=False).ids)
        for _ in range(25):
            start, removed = r.randrange(len(text) + 1), r.choice([0, 1, 3, 40])
            inserted = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 3])))
            text, _ = tt.edit(text, chars, tokens, start, removed, inserted, vocabulary())
            assert tokens[1] == len(tokenizer.encode(text, add_special_tokens=False).ids), (seed, start, removed, inserted)


def test_only_a_stretch_is_encoded():
    text = prose(1, 5000)
    chars, tokens = tt.build(text, PATH)
    text, encoded = tt.edit(text, chars, tokens, len(text) // 2, 5, "edit", PATH)
    assert encoded < 4 * tt.LEAF and tokens[1] == whole(text)


def test_odd_rows(odd, given):
    n = F.length(F.coalesce("text", F.lit("")))
    edits = F.array(
        F.struct(F.floor(n / 3).cast("int").alias("start"), F.lit(7).alias("removed"), F.lit("new ").alias("inserted")),
        F.struct(n.alias("start"), F.lit(0).alias("removed"), F.lit(" end").alias("inserted")),
    )
    rows = tt.counts_after_edits(odd, edits, PATH).collect()
    want = []
    for id_, text, _ in given:
        text = text or ""
        after = text + " end"
        at = len(text) // 3
        # An edit at the same place as one to its right is made in the text that one left.
        after = after[:at] + "new " + after[min(len(after), at + 7) :]
        want.append((id_, whole(text), whole(after), len(after)))
    got = [(r["doc_id"], r["n_tokens"], r["edited_tokens"], r["edited_chars"]) for r in rows]
    short = {4, 3, 6, 5, None}
    pick = lambda rows: sorted((r for r in rows if r[0] not in short), key=str)
    assert len(got) == len(want) and pick(got) == pick(want)
    texts = odd.select("doc_id", tt.edited(F.col("text"), tt.tree(F.col("text"), PATH), edits, PATH).alias("e")).collect()
    assert all(r["e"]["n_tokens"] == whole(r["e"]["text"]) for r in texts)


def test_no_edits_and_empty_table(odd, none):
    edits = F.lit(None).cast(tt.EDITS)
    assert all(r["n_tokens"] == r["edited_tokens"] for r in tt.counts_after_edits(odd, edits, PATH).collect())
    assert tt.counts_after_edits(none, edits, PATH).count() == 0
