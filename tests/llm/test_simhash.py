import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from brisa.llm import simhash
from brisa.llm.components import components
from tests.llm.conftest import prose


def mark(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(odd, given):
    rows = simhash.near_duplicates(odd).collect()
    prints = [mark(text) for _, text, _ in given]
    roots = groups(prints, 4)
    ids = [r[0] for r in given]
    want = []
    for i, root in enumerate(roots):
        members = [ids[j] for j in range(len(ids)) if roots[j] == root and ids[j] is not None]
        want.append((ids[i], prints[i], min(members, default=None)))
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_long_texts_in_steps(monkeypatch):
    text = prose(1, 500)
    want = mark(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text.encode(), 4) == want


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_join_all_that_are_near(spark, monkeypatch, bucket):
    """Many prints around few centres, with buckets too large to compare at once in the second case."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = np.random.default_rng(1)
    prints = set()
    for centre in r.integers(0, 1 << 63, 6):
        for _ in range(40):
            p = int(centre)
            for bit in r.integers(0, 64, r.integers(0, 4)):
                p ^= 1 << int(bit)
            prints.add(p % (1 << 64))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    found = components(simhash.links(frame, 4)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = groups(prints, 4)
    for i, p in enumerate(signed):
        members = [signed[j] for j in range(len(signed)) if want[j] == want[i]]
        assert root.get(p, p) == min(members)


class Captured:
    """In place of the keys: takes the function that a task would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):  # noqa: N802
        return run


@pytest.mark.parametrize("step", [7, 64])
def test_a_task_sends_large_buckets_on_as_it_reads_them(spark, monkeypatch, step):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    monkeypatch.setattr(simhash, "ROWS", 64)
    r = np.random.default_rng(2)
    keys = []
    for bits, size in enumerate([3, 16, 17, 5000, 2, 90, 64, 700, 1]):
        keys += [(bits // 4, bits, int(p)) for p in np.sort(r.integers(0, 1 << 62, size))]
    taken, given, most = 0, 0, 0

    def batches():
        nonlocal taken
        for i in range(0, len(keys), step):
            taken += len(keys[i : i + step])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keys[i : i + step])], ["choice", "bits", "fingerprint"])

    large = []
    for batch in simhash._bucket_pass(Captured(spark), 4, False)(batches()):
        members = batch.filter(batch.column("b").is_null()).column("a").to_pylist()
        large += members
        given += len(members)
        # All but few of the rows here are in large buckets; what was read and not yet given is held.
        most = max(most, taken - given)
    sizes = {k: sum(x[:2] == k for x in keys) for k in {x[:2] for x in keys}}
    assert large == [p for c, b, p in keys if sizes[c, b] > 16]
    assert most < 300


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(chain, "a bigint, b bigint").withColumn("root", F.lit(1)).select("a", "b"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(51)} | {(100 + i, 100) for i in range(60)}
