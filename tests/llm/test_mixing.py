import re

import numpy as np
import pytest

from brisa.llm import mixing
from tests.llm.conftest import prose


def test_shares():
    assert mixing.shares({"a": 100, "b": 100, "c": 100}, (3, 1, 2), 300, 2.0) == {"a": 150.0, "b": 50.0, "c": 100.0}
    # "a" stops at 20, its excess goes to the others by weight; null is last and weighs 2.
    found = mixing.shares({None: 200, "b": 100, "a": 10}, (3, 1, 2), 310, 2.0)
    assert found == pytest.approx({"a": 20, "b": 290 / 3, None: 580 / 3})
    assert mixing.shares({}, (3, 1, 2), 0, 2.0) == {}
    assert mixing.shares({"a": 0, "b": 10}, (3, 1, 2), 15, 2.0) == {"a": 0, "b": 15}


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_sums(seed):
    r = np.random.default_rng(seed)
    p, sizes = r.random(500), r.integers(0, 400, 500)
    out = mixing.flight(p, sizes)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and out @ sizes == pytest.approx(p @ sizes)


def test_flight_with_equal_sizes():
    out = mixing.flight(np.full(100, 0.3), np.full(100, 7))
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(30)


def test_landing_tries_all_ways():
    p, sizes = np.array([0.5, 0.5, 0.4]), np.array([10.0, 7.0, 3.0])
    assert (mixing.landing(p, sizes) @ sizes) == 10


@pytest.mark.parametrize("block", [8192, 16])
def test_targets_are_met(frame, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(i, prose(i, 5 + i * 37 % 90), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    found = mixing.mix(frame(rows)).collect()
    assert len(found) == 600
    taken = {}
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for r in found:
        assert abs(taken[r["source"]] - r["target"]) <= 3
    assert mixing.mix(frame(rows).repartition(11)).exceptAll(mixing.mix(frame(rows))).isEmpty()


def test_odd_rows(odd, given):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(given)
    want = sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in given if i is not None)
    assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"] is not None) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) <= 1.5 * total + 1e-6


def test_empty_table(none):
    assert mixing.mix(none).count() == 0
