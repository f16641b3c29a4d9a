"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one before anything is compared. Every vector has its home in the cell of its nearest centre and
visits each cell that a vector within the angle of the threshold may have as its home: if x lives with centre c,
such a vector can live with centre e only if x lies at most sin(angle) beyond the plane between them. So every
linked pair meets in the home cell of either, and no link is lost. Cells are compared in tiles of homes against
streams of vectors; a tile gives the number of links of its homes and only as many links as join its components.

Vectors of every size are compared, each with those of its own size: a cell holds vectors of one size, and each size
of more than a tile has centres of its own. Smaller ones are one cell each.

The centres are fitted on a bounded sample; all vectors are placed and compared. In many dimensions, vectors without
clusters visit most cells, and the work comes near to that of all pairs.

Vectors that are null or zero, hold null or non-finite components, or have no id link with nothing and stay. Vectors that differ by a positive factor only link with cosine 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm.common import partitions, stored
from brisa.llm.components import components

#: Vectors that the centres are fitted on at most.
SAMPLE = 20_000
#: Homes in a tile, and about so many in a cell.
TILE = 2048
CELLS = 1024
#: Vectors of a stream compared with a tile at a time.
STREAM = 8192


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so squares neither overflow nor vanish.
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres of a sample of unit vectors."""
    chosen = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        cell = (sample @ chosen.T).argmax(axis=1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, cell, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        some = norm > 1e-9
        chosen[some] = sums[some] / norm[some, None]
    return np.unique(chosen, axis=0)


def _apart(middle: np.ndarray) -> np.ndarray:
    between = middle[:, None, :] - middle[None, :, :]
    apart = np.sqrt((between**2).sum(axis=2))
    np.fill_diagonal(apart, 1.0)
    return apart


def _by_size(batch: pa.RecordBatch):
    """Size of vectors, and the rows of a batch that have it."""
    sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
    found = np.unique(sizes).tolist()
    for size in found:
        yield size, batch if len(found) == 1 else batch.take(pa.array(np.flatnonzero(sizes == size)))


def _placed(vectors: DataFrame, middle: dict[int, tuple[int, np.ndarray]], threshold: float, visits: bool) -> DataFrame:
    """(cell, home, id, weight, vector): homes, and visits to other cells of the same size.

    ``middle`` has the first cell and the centres by size; a size that is not in it is one cell, -size.
    """
    apart = {size: _apart(own) for size, (_, own) in middle.items()}
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9

    def run(batches):
        for size, batch in (x for batch in batches if batch.num_rows for x in _by_size(batch)):
            raw = _matrix(batch.column(2))
            first_cell, own = middle.get(size, (-size, None))
            for start in range(0, len(raw), 2048):
                part = np.ascontiguousarray(raw[start : start + 2048])
                dots = np.zeros((len(part), 1)) if own is None else _units(part) @ own.T
                home = dots.argmax(axis=1)
                near = np.zeros(dots.shape, bool)
                if visits and own is not None:
                    near = (dots[np.arange(len(part)), home][:, None] - dots) <= reach * apart[size][home]
                near[np.arange(len(part)), home] = True
                row, cell = np.nonzero(near)
                ids, weights = (batch.column(i).slice(start, len(part)).to_numpy(zero_copy_only=False) for i in range(2))
                data = [v.tobytes() for v in part]
                for i in range(0, len(row), STREAM):
                    r, c = row[i : i + STREAM], cell[i : i + STREAM]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((c + first_cell).astype(np.int32)),
                            pa.array(home[r] == c),
                            pa.array(ids[r]),
                            pa.array(weights[r]),
                            pa.array([data[k] for k in r], pa.binary()),
                        ],
                        ["cell", "home", "id", "weight", "vector"],
                    )

    return vectors.select("id", "weight", "vector").mapInArrow(
        run, "cell int, home boolean, id bigint, weight bigint, vector binary"
    )


def _joined(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Smallest node that each of ``count`` nodes reaches by links a-b."""
    label = np.arange(count)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(tiles: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Per tile: links (a, b) that join its components, and numbers of links as (a, null, links)."""

    def run(batches):
        key, homes, ids, weights, units, links = None, [], None, None, None, None

        def ended():
            if key is not None and links is not None and links.any():
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.nulls(len(at), pa.int64()), pa.array(links[at])], ["a", "b", "links"]
                )

        for batch in batches:
            cells, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(numbers) != 0)) + 1
            for start, end in zip([0, *change], [*change, len(cells)]):
                if start == end:
                    continue
                if (cells[start], numbers[start]) != key:
                    yield from ended()
                    key, homes, links = (cells[start], numbers[start]), [], None
                own = batch.column(2).slice(start, end - start).to_numpy(zero_copy_only=False)
                some = [batch.column(i).slice(start, end - start) for i in (3, 4)]
                one, two = (c.to_numpy(zero_copy_only=False) for c in some)
                raw = np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in batch.column(5).slice(start, end - start)), kind)
                raw = raw.reshape(end - start, -1)
                # The homes of a tile come first.
                first = int(own.sum())
                if first:
                    homes.append((one[:first], two[:first], raw[:first]))
                if first == end - start:
                    continue
                if links is None:
                    if not homes:
                        continue
                    ids, weights = (np.concatenate([h[i] for h in homes]) for i in range(2))
                    units = _units(np.concatenate([h[2] for h in homes]))
                    narrow = units.astype(np.float32)
                    links = np.zeros(len(ids), np.int64)
                    homes = [None]
                for i in range(first, end - start, STREAM):
                    there = slice(i, min(i + STREAM, end - start))
                    others = _units(raw[there])
                    # Single precision finds candidates, double precision decides.
                    rough = narrow @ others.astype(np.float32).T >= np.float32(threshold - 1e-4)
                    a, b = np.nonzero(rough)
                    good = np.zeros(len(a), bool)
                    for j in range(0, len(a), 1 << 16):
                        x, y = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                        good[j : j + (1 << 16)] = (units[x] * others[y]).sum(axis=1) >= threshold
                    good &= ids[a] != one[there][b]
                    a, b = a[good], b[good]
                    if not len(a):
                        continue
                    np.add.at(links, a, two[there][b])
                    names = np.concatenate([ids, one[there]])
                    label = _joined(a, b + len(ids), len(names))
                    at = np.flatnonzero(label != np.arange(len(names)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[at]), pa.array(names[label[at]]), pa.nulls(len(at), pa.int64())], ["a", "b", "links"]
                    )
        yield from ended()

    n = partitions(tiles.sparkSession)
    dealt = tiles.repartition(n, "cell", "tile").sortWithinPartitions("cell", "tile", F.desc("own"), "id")
    return dealt.mapInArrow(run, "a bigint, b bigint, links bigint")


def near_duplicates(
    rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    ``n_links`` counts the other vectors of the same size with a cosine of at least ``threshold``; the component is named by its smallest id,
    whose vector is kept. Rows that repeat an id count as vectors of their own.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda v: v != 0) & F.col("id").isNotNull(), F.lit(False))
    distinct = stored(rows.where(usable).groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vectors")
    answer = rows.select("id", F.when(usable, F.col("vector")).alias("vector"))
    if distinct.isEmpty():
        named = answer.withColumns({"links": F.lit(0).cast("long"), "root": F.col("id")})
    else:
        size = F.size("vector").alias("size")
        large = {r["size"]: r["count"] for r in distinct.groupBy(size).count().where(F.col("count") > TILE).collect()}
        # Every vector has as great a chance to be in the sample, whatever its id.
        picked = distinct.where(size.isin(*large)).orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).select("vector").collect()
        samples: dict[int, list] = {}
        for r in picked:
            samples.setdefault(len(r["vector"]), []).append(r["vector"])
        middle, first_cell = {}, 0
        for n, sample in sorted(samples.items()):
            own = centres(_units(np.array(sample, np.float64)), int(min(CELLS, -(-large[n] // TILE), len(sample))))
            middle[n] = (first_cell, own)
            first_cell += len(own)
        kind = "float32" if distinct.schema["vector"].dataType.elementType.typeName() == "float" else "float64"
        vectors = distinct if kind == "float32" else distinct.withColumn("vector", F.col("vector").cast("array<double>"))
        homes = _placed(vectors, middle, threshold, False).groupBy("cell").count()
        homes = homes.where(F.col("count") > TILE).collect()  # a row per cell of several tiles
        tiles = spark.createDataFrame([(r["cell"], -(-r["count"] // TILE)) for r in homes], "_cell int, _tiles int")
        placed = _placed(vectors, middle, threshold, True)
        dealt = placed.join(F.broadcast(tiles), F.col("cell") == F.col("_cell"), "left")
        dealt = dealt.withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
        dealt = dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        home_here = F.col("home") & (F.pmod(F.xxhash64("id"), F.col("_tiles")) == F.col("tile"))
        # A home is also compared with as one of the stream.
        roles = F.explode(F.when(home_here, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
        dealt = dealt.withColumn("own", roles).select("cell", "tile", "own", "id", "weight", "vector")
        found = stored(_compared(dealt, threshold, kind), "cosine")
        links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
        roots = components(found.where("b IS NOT NULL").select("a", "b"))
        known = (
            distinct.join(links, F.col("id") == F.col("a"), "left")
            .join(roots, F.col("id") == F.col("node"), "left")
            .select(
                F.col("vector").alias("v"),
                (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
                F.coalesce("root", "id").alias("root"),
            )
        )
        named = answer.join(known, F.col("vector") == F.col("v"), "left").select(
            "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")
        )
    return named.select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept")
    )
