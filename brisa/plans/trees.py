"""Forests and boosted trees for regression, grown by levels from histograms.

The estimators and the fitted models are those of ``pyspark.ml``, and so are thresholds, figures of nodes and the choice of splits; only
the passes over the rows are made here. A row is held as one small number per input, the place of its value among the thresholds, in
blocks of rows. A pass adds up weight, sum and sum of squares per open node, input and place in a task, a block at a time with numpy; the
figures of a node meet in another task, which takes its best split. The driver sees splits, never rows or figures per place.

Boosting keeps the rows of each round by the same draws as ``pyspark.ml``, so it gives the same trees but for the last digits of sums. The
Poisson draws of a forest are made per tree and partition from the seed, by numpy, so its trees are others of the same kind.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brisa.session import new_dir

# These functions travel with the tasks, so executors need no copy of the module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block and, by the mean, of a task that passes over them; nodes whose figures one task adds up; bytes of figures up to which
#: the driver does that instead; trees of a forest that grow at a time; and rounds between checkpoints of the boosted predictions.
ROWS, TASK, NODES, TO_DRIVER, GROUP, CHECKPOINT = 65_536, 1_000_000, 32, 32 << 20, 50, 40
#: An impurity below this counts as none, as in ``pyspark.ml``.
EPSILON = 2.0**-52
NODE_DATA = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


# --- Thresholds -----------------------------------------------------------


def thresholds(data: DataFrame, columns: list[str], rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """At most ``max_bins`` - 1 cuts per input, by the values of the rows that ``pyspark.ml`` would take a look at."""
    spark, bins = data.sparkSession, min(max_bins, rows)
    wanted = max(bins * bins, 10_000)
    share = wanted / rows if wanted < rows else 1.0
    looked_at = data.select(*columns)
    if share < 1.0:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sample = looked_at._jdf.toJavaRDD().sample(False, share, draw)
        looked_at = DataFrame(spark._jsparkSession.createDataFrame(sample, looked_at._jdf.schema()), spark)
    table = looked_at.toArrow()
    return [cuts(table.column(c).to_numpy(), share * rows, bins - 1) for c in columns]


def cuts(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Midpoints that part the distinct values into runs of about equal weight; zeros weigh what is missing from the expected number."""
    values = values[values != 0.0]
    if not len(values):
        return np.empty(0)
    distinct, counts = np.unique(values, return_counts=True)
    weights = counts.astype(float)
    missing = expected - len(values)
    if missing > EPSILON * len(values) * len(values):
        at = np.searchsorted(distinct, 0.0)
        distinct, weights = np.insert(distinct, at, 0.0), np.insert(weights, at, missing)
    if len(distinct) - 1 <= most:
        return (distinct[:-1] + distinct[1:]) / 2.0
    stride = expected / (most + 1)
    found, current, target = [], weights[0], stride
    for i in range(1, len(distinct)):
        previous, current = current, current + weights[i]
        if abs(previous - target) < abs(current - target):
            found.append((distinct[i - 1] + distinct[i]) / 2.0)
            target += stride
    return np.array(found)


# --- Blocks of rows -------------------------------------------------------


def blocks(data: DataFrame, label: str, columns: list[str], edges: list[np.ndarray], kept: list[int], share: float) -> RDD:
    """(places: inputs x rows, labels, kept rows: rounds x bits) for every ``ROWS`` rows of a partition, in their order.

    The rows of a round are drawn per partition with its seed.
    """
    draws = [(F.rand(s + 1) < share).alias(f"_keep{i}") for i, s in enumerate(kept)]
    small = np.uint8 if max(map(len, edges)) < 256 else np.uint16

    def block(table: pa.Table) -> pa.RecordBatch:
        labels = table.column(label).to_numpy()
        places = np.empty((len(columns), len(labels)), dtype=small)
        for i, (name, cut) in enumerate(zip(columns, edges)):
            values = table.column(name).to_numpy()
            if np.isnan(values).any():
                raise ValueError(f"no number in an input: {name}")
            places[i] = np.searchsorted(cut, values)
        if np.isnan(labels).any():
            raise ValueError("a training row without a label")
        keep = [np.packbits(table.column(f"_keep{i}").to_numpy()) for i in range(len(kept))]
        parts = [places, labels, np.array(keep, dtype=np.uint8)]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["places", "labels", "keep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, ROWS))
                held, rows = table.slice(ROWS).to_batches(), rows - ROWS
        if rows:
            yield block(pa.Table.from_batches(held))

    def arrays(row):
        labels = np.frombuffer(row["labels"])
        return (
            np.frombuffer(row["places"], dtype=small).reshape(len(columns), len(labels)),
            labels,
            np.frombuffer(row["keep"], dtype=np.uint8).reshape(len(kept), -(-len(labels) // 8)),
        )

    source = data.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in columns], *draws)
    return source.mapInArrow(run, "places binary, labels binary, keep binary").rdd.map(arrays)


def fewer_tasks(held: RDD, rows: int, trees: int) -> RDD:
    """Draws are made per partition; passes over the rows take several of these a task, as many as make full rounds of tasks.

    Few rows of one tree are one task, so that most of a pass is not starting tasks."""
    cores, blocks_at_least = held.context.defaultParallelism, -(-rows * trees // ROWS)
    tasks = blocks_at_least if blocks_at_least < cores else cores * -(-rows // (TASK * cores))
    return held.coalesce(min(held.getNumPartitions(), tasks))


# --- Trees ----------------------------------------------------------------


@dataclass
class Tree:
    """A tree while it grows. The right child of a node follows its left one; a leaf leads to itself. ``open`` are the nodes of the last level that may be split."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [1 << 30])
    left: list[int] = field(default_factory=lambda: [0])
    #: Per node: weight, sum and sum of squares; the gain of its split; its impurity, -1 where no split was allowed.
    sums: list[tuple] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    impurity: list[float] = field(default_factory=lambda: [-1.0])
    open: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def grow(self, splits: dict[int, dict], max_depth: int) -> None:
        """Split the open nodes by what was found for them, and go on to the next level."""
        opened = []
        for node in self.open:
            found = splits.get(node)
            if found is None:
                continue
            self.sums[node] = found["sums"]
            if found["gain"] == -np.inf:
                self.impurity[node] = -1.0
                continue
            self.impurity[node] = found["impurity"]
            if found["gain"] <= 0:
                continue
            self.gain[node], self.feature[node], self.cut[node], self.left[node] = found["gain"], found["feature"], found["cut"], len(self.left)
            for sums in (found["left"], found["right"]):
                child, impurity = len(self.left), float(variance(*sums))
                self.feature.append(0)
                self.cut.append(1 << 30)
                self.left.append(child)
                self.sums.append(sums)
                self.gain.append(-1.0)
                self.impurity.append(impurity)
                if self.depth + 1 < max_depth and abs(impurity) >= EPSILON:
                    opened.append(child)
        self.open, self.depth = opened, self.depth + 1

    def value(self, node: int) -> float:
        weight, total, _ = self.sums[node]
        return total / weight if weight else 0.0

    def arrays(self) -> tuple:
        """What tasks need to send rows down: inputs, cuts and left children of the nodes, and the place of each among the open ones."""
        place = np.full(len(self.left), -1)
        place[self.open] = np.arange(len(self.open))
        return np.array(self.feature), np.array(self.cut), np.array(self.left), place, self.depth

    def step(self, nodes: list[int]) -> tuple:
        """Inputs and cuts of nodes of the level above, and for both children of each the place among the open nodes, -1 for a leaf."""
        at, place = np.array(nodes), self.arrays()[3]
        left = np.array(self.left)[at]
        split = left != at
        child = np.column_stack([place[left], np.where(split, place[left + split], -1)])
        return np.array(self.feature)[at], np.array(self.cut)[at], np.where(split[:, None], child, -1).ravel()

    def nodes(self, edges: list[np.ndarray], columns: list[int]) -> list[tuple]:
        """The nodes in order from the root, left first, as a model stores them; leaves of equal value under one node are one leaf."""
        same = {}
        for node in reversed(range(len(self.left))):
            left = self.left[node]
            if left == node or (left in same and left + 1 in same and same[left] == same[left + 1]):
                same[node] = self.value(node if left == node else left)
        out = []

        def add(node: int) -> int:
            at, sums = len(out), list(map(float, self.sums[node]))
            out.append(None)
            if node in same:
                out[at] = (at, same[node], self.impurity[node], sums, int(sums[0]), -1.0, -1, -1, (-1, [], -1))
                return at
            left, right = add(self.left[node]), add(self.left[node] + 1)
            split = (columns[self.feature[node]], [float(edges[self.feature[node]][self.cut[node]])], -1)
            out[at] = (at, self.value(node), self.impurity[node], sums, int(sums[0]), self.gain[node], left, right, split)
            return at

        add(0)
        return out


def variance(weight, total, squares):
    """Mean squared distance from the mean; 0 without rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight == 0, 0.0, (squares - total * total / weight) / weight)


def reached(tree: tuple, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows that come to an open node, and the node's place among the open ones."""
    feature, cut, left, place, depth = tree
    flat, n = places.ravel(), places.shape[1]
    at = np.zeros(len(rows), dtype=np.int64)
    for level in range(depth):
        at = left.take(at) + (flat.take(feature.take(at) * n + rows) > cut.take(at))
        # What ended in a leaf above goes no further.
        if level < depth - 1:
            going = np.flatnonzero(left.take(at) != at)
            if len(going) < len(at):
                at, rows = at.take(going), rows.take(going)
    found = place.take(at)
    if depth:
        going = np.flatnonzero(found >= 0)
        found, rows = found.take(going), rows.take(going)
    return rows, found


def leaves(tree: tuple, places: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    feature, cut, left, _, depth = tree
    flat, n = places.ravel(), places.shape[1]
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    for _ in range(depth):
        at = left.take(at) + (flat.take(feature.take(at) * n + rows) > cut.take(at))
    return at


def histograms(places, rows, found, targets, weights, width: int, nodes: int) -> np.ndarray:
    """nodes x (weight, sum, sum of squares) x inputs x places, of rows that have come to these nodes."""
    sums = targets if weights is None else weights * targets
    squares = sums * targets
    out = np.empty((3, len(places), nodes * width))
    start = found * width
    for i, column in enumerate(places):
        at = start + (column if len(rows) == len(column) else column.take(rows))
        for k, values in enumerate((weights, sums, squares)):
            out[k, i] = np.bincount(at, values, nodes * width)
    return out.reshape(3, len(places), nodes, width).transpose(2, 0, 1, 3)


def best_split(figures: np.ndarray, numbers: np.ndarray, known: tuple | None, least: int) -> dict:
    """The first split of highest gain. ``numbers`` are the cuts per input, ``known`` the sums of the node if its parent gave them."""
    left = np.cumsum(figures, axis=2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    right = total - left
    usable = np.flatnonzero(numbers)
    if known is None:
        sums = left[:, usable[0], 0] + right[:, usable[0], 0] if len(usable) else total[:, 0, 0]
    else:
        sums = np.array(known)
    impurity = float(variance(*sums))
    none = {"gain": -np.inf, "impurity": impurity, "sums": tuple(sums.tolist())}
    allowed = (np.arange(left.shape[2]) < numbers[:, None]) & (left[0] >= least) & (right[0] >= least)
    if not allowed.any():
        return none
    weight = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity - left[0] / weight * variance(*left) - right[0] / weight * variance(*right)
    gain = np.where(allowed & (gain >= 0), gain, -np.inf)
    feature, cut = (int(i) for i in np.unravel_index(np.argmax(gain), gain.shape))
    if gain[feature, cut] == -np.inf:
        return none
    found = {"gain": float(gain[feature, cut]), "feature": feature, "cut": cut}
    return none | found | {side: tuple(of[:, feature, cut].tolist()) for side, of in (("left", left), ("right", right))}


class Pass:
    """What a task finds for the open nodes of a tree: figures for nodes with many rows, the rows themselves for those that have fewer."""

    def __init__(self, nodes: int, width: int):
        self.nodes, self.width, self.taken = nodes, width, []

    def add(self, places: np.ndarray, rows: np.ndarray, found: np.ndarray, targets: np.ndarray, weights: np.ndarray | None) -> None:
        """Rows of a block, which have come to these nodes; weights are those of the rows given, targets those of the block."""
        if len(rows):
            self.taken.append((places, rows, found, targets.take(rows), weights))

    def parts(self, first: int) -> Iterator[tuple]:
        """(task, (places, nodes, targets, weights of rows, nodes with figures, figures)), nodes numbered through from ``first``."""
        if not self.taken:
            return
        inputs = len(self.taken[0][0])
        counts = sum(np.bincount(found, minlength=self.nodes) for _, _, found, _, _ in self.taken)
        many = counts * (inputs + 16) > 24 * inputs * self.width
        total, few, place = 0.0, [], np.cumsum(many) - 1
        for places, rows, found, targets, weights in self.taken:
            large = many.take(found)
            pick = lambda at, values: None if values is None else values[at]
            if large.any():
                at = slice(None) if large.all() else np.flatnonzero(large)
                total = total + histograms(places, rows[at], place.take(found[at]), targets[at], pick(at, weights), self.width, int(many.sum()))
            if not large.all():
                at = np.flatnonzero(~large)
                few.append((places.take(rows.take(at), 1), found.take(at), targets.take(at), pick(at, weights)))
        join = lambda k, axis=0: None if few[0][k] is None else np.concatenate([f[k] for f in few], axis)
        places, found, targets, weights = (join(0, 1), join(1), join(2), join(3)) if few else (None, np.empty(0, dtype=np.int64), None, None)
        # A stable order: what is added up for a node comes in the order of its rows.
        order = np.argsort(found, kind="stable")
        numbers, heavy = found.take(order) + first, np.flatnonzero(many) + first
        for task in range(first // NODES, (first + self.nodes - 1) // NODES + 1):
            low, high = np.searchsorted(numbers, [task * NODES, (task + 1) * NODES])
            here, rows = slice(*np.searchsorted(heavy, [task * NODES, (task + 1) * NODES])), order[low:high]
            light = (places.take(rows, 1), numbers[low:high], targets.take(rows), None if weights is None else weights.take(rows)) if len(rows) else None
            if light or len(heavy[here]):
                yield task, (light, heavy[here], total[here] if len(heavy[here]) else None)


def splits_of(found: RDD, known: list, numbers: np.ndarray, least: int) -> dict[int, dict]:
    """The best split per node, from (task, (partition, what its rows add)), which is added up in the order of the partitions."""
    width = int(numbers.max()) + 1

    def choose(pairs: Iterable) -> Iterator:
        tasks: dict[int, list] = {}
        for task, part in pairs:
            tasks.setdefault(task, []).append(part)
        for task, parts in tasks.items():
            total, seen = np.zeros((NODES, 3, len(numbers), width)), np.zeros(NODES, dtype=bool)
            parts = [part for _, part in sorted(parts, key=lambda p: p[0])]
            if light := [part[0] for part in parts if part[0]]:
                places, nodes, targets = (np.concatenate([p[k] for p in light], axis) for k, axis in ((0, 1), (1, 0), (2, 0)))
                weights = None if light[0][3] is None else np.concatenate([p[3] for p in light])
                nodes -= task * NODES
                total += histograms(places, np.arange(len(nodes)), nodes, targets, weights, width, NODES)
                seen[nodes] = True
            for _, heavy, figures in parts:
                if len(heavy):
                    total[heavy - task * NODES] += figures
                    seen[heavy - task * NODES] = True
            for node in np.flatnonzero(seen):
                yield task * NODES + int(node), best_split(total[node], numbers, known[task * NODES + node], least)

    if len(known) * 24 * len(numbers) * width * found.getNumPartitions() <= TO_DRIVER:
        return dict(choose(found.collect()))
    tasks = -(-len(known) // NODES)
    return dict(found.partitionBy(tasks, int).mapPartitions(choose).collect())


# --- The two ensembles ----------------------------------------------------


class Poisson:
    """Poisson draws, to 32 bits of their probabilities: by the upper half of a random number, and by all of it where that does not tell."""

    def __init__(self, mean: float):
        terms = np.cumsum(np.log(np.r_[1.0, np.full(199, mean) / np.arange(1, 200)])) - mean
        self.steps = np.minimum(np.round(np.cumsum(np.exp(terms)) * 2.0**32), 2.0**32).astype(np.uint64)
        first = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
        self.table = self.count(first).astype(np.uint8)
        self.unsure = self.count(first + np.uint64(0xFFFF)) != self.table

    def count(self, drawn: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps, drawn.astype(np.uint64), side="right")

    def of(self, key: list[int], block: int, rows: int) -> np.ndarray:
        """The draws of a block; they follow from the key and the number of the block."""
        drawn = np.random.Generator(np.random.SFC64([*key, block])).integers(0, 1 << 32, rows, dtype=np.uint32)
        upper = drawn >> np.uint32(16)
        found = self.table.take(upper)
        unsure = np.flatnonzero(self.unsure.take(upper))
        found[unsure] = self.count(drawn.take(unsure))
        return found


def grow_forest(data: RDD, edges: list[np.ndarray], estimator: RandomForestRegressor) -> list[Tree]:
    """The trees a group at a time, a pass over the rows a level. Rows of open nodes stay with their block, with node and draw."""
    numbers, seed, share = np.array([len(e) for e in edges]), estimator.getSeed(), estimator.getSubsamplingRate()
    width, deepest = int(numbers.max()) + 1, estimator.getMaxDepth()
    small = np.uint16 if deepest < 16 else np.int32

    def drawn(group: range, rows: Iterator) -> Iterator:
        draws = Poisson(share)
        for (partition, block), (places, labels, _) in rows:
            open_ = {}
            for number in group:
                weights = draws.of([seed % 2**64, number << 32 | partition], block, len(labels))
                taken = np.flatnonzero(weights)
                open_[number] = taken.astype(np.uint16), np.zeros(len(taken), dtype=small), weights.take(taken)
            yield places, labels, open_

    def lowered(steps: dict[int, tuple], block: tuple) -> tuple:
        places, labels, open_ = block
        flat, n, lower = places.ravel(), len(labels), {}
        for number, (feature, cut, child) in steps.items():
            rows, found, weights = open_[number]
            at = found.astype(np.int64)
            to = child.take(2 * at + (flat.take(feature.take(at) * n + rows) > cut.take(at)))
            going = np.flatnonzero(to >= 0)
            lower[number] = rows.take(going), to.take(going).astype(small), weights.take(going)
        return places, labels, lower

    def figures(first: dict[int, int], nodes: dict[int, int], index: int, rows: Iterator) -> Iterator:
        held = list(rows)
        for number in nodes:
            found = Pass(nodes[number], width)
            for places, labels, open_ in held:
                taken, at, weights = open_[number]
                found.add(places, taken.astype(np.int64), at.astype(np.int64), labels, weights.astype(float))
            for task, part in found.parts(first[number]):
                yield task, (index, part)

    trees = [Tree() for _ in range(estimator.getNumTrees())]
    for start in range(0, len(trees), GROUP):
        group = range(start, min(start + GROUP, len(trees)))
        state = data.mapPartitions(partial(drawn, group)).persist(StorageLevel.MEMORY_AND_DISK)
        for depth in range(deepest):
            growing = [i for i in group if trees[i].open]
            if not growing:
                break
            first, known, places = {}, [], []
            for i in growing:
                first[i] = len(known)
                known += [trees[i].sums[node] if depth else None for node in trees[i].open]
                places += [(i, node) for node in trees[i].open]
            nodes = {i: len(trees[i].open) for i in growing}
            found = splits_of(state.mapPartitionsWithIndex(partial(figures, first, nodes)), known, numbers, estimator.getMinInstancesPerNode())
            by_tree: dict[int, dict] = {i: {} for i in growing}
            for at, split in found.items():
                by_tree[places[at][0]][places[at][1]] = split
            before = {i: trees[i].open for i in growing}
            for i in growing:
                trees[i].grow(by_tree[i], deepest)
            steps = {i: trees[i].step(before[i]) for i in growing if trees[i].open}
            above, state = state, state.map(partial(lowered, steps)).persist(StorageLevel.MEMORY_AND_DISK)
            if depth:
                last.unpersist()
            last = above
        last.unpersist()
        state.unpersist()
    return trees


def grow_boosted(data: RDD, edges: list[np.ndarray], estimator: GBTRegressor) -> list[Tree]:
    """One tree a round on what the trees before it leave of the labels; predictions stay with the rows."""
    numbers = np.array([len(e) for e in edges])

    def figures(tree: tuple, first: bool, index: int, rows: Iterator) -> Iterator:
        found = Pass(int(tree[3].max()) + 1, int(numbers.max()) + 1)
        for places, labels, keep, predicted in rows:
            kept = np.flatnonzero(np.unpackbits(keep[0], count=len(labels)))
            found.add(places, *reached(tree, places, kept), labels if first else 2.0 * (labels - predicted), None)
        for task, part in found.parts(0):
            yield task, (index, part)

    def scored(tree: tuple, values: np.ndarray, row: tuple) -> tuple:
        places, labels, keep, predicted = row
        return places, labels, keep[1:], predicted + values.take(leaves(tree, places))

    trees: list[Tree] = []
    state = data.map(lambda row: (*row, np.zeros(len(row[1])))).persist(StorageLevel.MEMORY_AND_DISK)
    for m in range(estimator.getMaxIter()):
        before = None
        if m:
            last, weight = trees[-1], estimator.getStepSize() if m > 1 else 1.0
            values = np.array([last.value(node) for node in range(len(last.left))]) * weight
            before, state = state, state.map(partial(scored, last.arrays(), values)).persist(StorageLevel.MEMORY_AND_DISK)
            if m % CHECKPOINT == 0:
                state.checkpoint()
        tree = Tree()
        while tree.open and tree.depth < estimator.getMaxDepth():
            known = [tree.sums[node] if tree.depth else None for node in tree.open]
            found = splits_of(state.mapPartitionsWithIndex(partial(figures, tree.arrays(), not m)), known, numbers, estimator.getMinInstancesPerNode())
            tree.grow({node: found[i] for i, node in enumerate(tree.open) if i in found}, estimator.getMaxDepth())
        if before:
            before.unpersist()
        trees.append(tree)
    state.unpersist()
    return trees


# --- Estimators and models ------------------------------------------------


def fit(data: DataFrame, estimator: RandomForestRegressor | GBTRegressor, columns: list[str]) -> RandomForestRegressionModel | GBTRegressionModel:
    """What ``estimator.fit`` gives for a vector of these columns: squared error, every input at every split, any number of rows."""
    spark, label = data.sparkSession, estimator.getLabelCol()
    boosted = isinstance(estimator, GBTRegressor)
    rows = data.count()
    edges = thresholds(data, columns, rows, estimator.getMaxBins(), estimator.getSeed())
    # An input of one value parts nothing; one of them is kept where there is no other.
    used = [i for i, e in enumerate(edges) if len(e)] or [0]
    names, edges = [columns[i] for i in used], [edges[i] for i in used]
    seeds = [estimator.getSeed() + m for m in range(estimator.getMaxIter())] if boosted else []
    held = blocks(data, label, names, edges, seeds, estimator.getSubsamplingRate())
    if boosted:
        trees = grow_boosted(fewer_tasks(held, rows, 1), edges, estimator)
    else:
        numbered = held.mapPartitionsWithIndex(lambda index, rows: (((index, i), row) for i, row in enumerate(rows)))
        numbered = fewer_tasks(numbered, rows, estimator.getNumTrees()).persist(StorageLevel.MEMORY_AND_DISK)
        trees = grow_forest(numbered, edges, estimator)
        numbered.unpersist()
    return stored_model(spark, estimator, [tree.nodes(edges, used) for tree in trees], len(columns))


def _settings(spark: SparkSession, estimator) -> dict:
    path = new_dir(spark, "estimator")
    estimator.save(path)
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def stored_model(spark: SparkSession, estimator, trees: list[list[tuple]], features: int):
    """The model of these nodes, by way of its stored form."""
    boosted = isinstance(estimator, GBTRegressor)
    kind = GBTRegressionModel if boosted else RandomForestRegressionModel
    path, package = new_dir(spark, "model"), "org.apache.spark.ml.regression"
    whole = _settings(spark, estimator) | {"class": f"{package}.{kind.__name__}", "numFeatures": features, "numTrees": len(trees)}
    single = _settings(spark, DecisionTreeRegressor(maxDepth=estimator.getMaxDepth(), seed=estimator.getSeed()))
    single = single | {"class": f"{package}.DecisionTreeRegressionModel", "numFeatures": features}
    weight = lambda i: estimator.getStepSize() if boosted and i else 1.0
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    weights = [(i, json.dumps(single | {"uid": f"{single['uid']}_{i}"}), weight(i)) for i in range(len(trees))]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    form = to_arrow_schema(StructType.fromDDL(NODE_DATA))
    numbers = pa.array([i for i, tree in enumerate(trees) for _ in tree], form.field(0).type)
    nodes = pa.table([numbers, pa.array([node for tree in trees for node in tree], form.field(1).type)], schema=form)
    spark.createDataFrame(nodes).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)
