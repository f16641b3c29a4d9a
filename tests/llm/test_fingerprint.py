import hashlib

import numpy as np
import pyarrow as pa

from brisa.llm import fingerprint as fp
from tests.llm.conftest import prose


def test_edits_follow_the_next_document(odd, given):
    rows = fp.edited_likeness(odd).collect()
    assert len(rows) == len(given)
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (id_, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((id_, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)


def test_empty_table(none):
    assert fp.edited_likeness(none).count() == 0


def test_one_document_follows_itself(frame):
    row = fp.edited_likeness(frame([(5, "abcdef")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert row["near_next"] == 1


def test_equal_texts_have_equal_digests_whatever_stands_beside():
    text = prose(1, 300)
    alone = fp.digests(pa.array([text]))
    beside = fp.digests(pa.array(["x", text, None, "", text, prose(2, 90_000)]))
    assert (beside[1] == alone[0]).all() and (beside[4] == alone[0]).all()
    assert (beside[2] == beside[3]).all()


def test_counts_equal_a_plain_loop(monkeypatch):
    texts = [prose(i, 50) for i in range(5)] + ["", "abc", "abcd"]
    want = np.zeros((len(texts), fp.BUCKETS), int)
    for row, text in enumerate(texts):
        b = text.encode()
        for i in range(len(b) - 3):
            for salt, (j, k) in enumerate(fp.SHAPES):
                triplet = (b[i] << 16 | b[i + j] << 8 | b[i + k]) + (salt << 24)
                want[row, (triplet * 0x9E3779B1 % (1 << 32)) >> 24] += 1
    data, places = fp.text_bytes(pa.array(texts))
    assert (fp.triplet_counts(data, places) == want).all()
    monkeypatch.setattr(fp, "STEP", 37)
    assert (fp.triplet_counts(data, places) == want).all()


def test_likeness_falls_with_edits():
    text, other = prose(1, 400), prose(2, 400, "mnopqrst")
    half = len(text) // 2
    d = fp.digests(pa.array([text, text[:half] + "zz" + text[half:], text[:half] + other[:half], other]))
    near = [1 - x / fp.UNLIKE for x in fp.differences(np.repeat(d[:1], 4, axis=0), d)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3]
