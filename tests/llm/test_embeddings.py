import numpy as np
import pytest

from brisa.llm import embeddings


def vectors(seed=0, groups=30, size=16):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = r.normal(size=size)
        out += [centre + r.normal(size=size) * s for s in (0, 0.05, 0.15, 0.2, 0.25)]
    return out + [out[0]] * 20 + [out[7] * 3]


def brute(rows, threshold):
    units = {}
    for i, (_, v) in enumerate(rows):
        ok = v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            u = np.array(v, float)
            units[i] = u / np.linalg.norm(u)
    near = {i: {j for j in units if j != i and i in units and units[i] @ units[j] >= threshold} for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in seen)))
    return out


@pytest.mark.parametrize("tile, kind", [(2048, "float"), (13, "float"), (13, "double")])
def test_links_equal_brute_force(spark, monkeypatch, tile, kind):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "STREAM", 32)
    rows = [(i * 3, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors())]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 15, [float("inf")] * 16, [], rows[4][1][:15] + [None]]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr("*", "vec_id AS id", "1 AS cell")
    found = embeddings.near_duplicates(frame.repartition(4), 0.95).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found)
    assert got == brute(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("tile", [2048, 13])
def test_vectors_of_every_size_link(spark, monkeypatch, tile):
    """Two sizes with as many vectors, one with few, and copies of one vector; equal-sized ones link, others do not."""
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "STREAM", 32)
    parts = [vectors(1, 20, 16), vectors(2, 20, 8), vectors(3, 2, 5), [[1.0, 2.0]] * 4 + [[2.0, 4.0]], [[1.0] * 16, [1.0] * 8, [3.0]]]
    rows = [(i * 3, [float(np.float32(x)) for x in v]) for i, v in enumerate(v for part in parts for v in part)]
    want = []
    units = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    near = [{j for j, u in enumerate(units) if j != i and len(u) == len(x) and x @ u >= 0.95} for i, x in enumerate(units)]
    for i, (id_, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        want.append((id_, len(near[i]), min(rows[j][0] for j in seen)))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    found = embeddings.near_duplicates(frame, 0.95).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == want


def test_rows_without_id_and_equal_ids(spark):
    v = [1.0, 2.0]
    frame = spark.createDataFrame([(None, v), (5, v), (5, v), (6, [2.0, 4.0])], "vec_id bigint, embedding array<float>")
    found = [tuple(r) for r in embeddings.near_duplicates(frame).collect()]
    assert sorted(found, key=str) == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (None, 0, None, None)]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_duplicates(frame).count() == 0
