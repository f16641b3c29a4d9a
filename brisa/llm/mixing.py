"""Mixing sources to target weights by the cube method.

A source's share of the mix gives every document of it the same expected number of copies: a whole
number of them for all, and a fractional inclusion probability for one more. The cube method rounds
these probabilities to 0 or 1 without moving the balanced totals: among the undecided documents it
moves the probabilities along a vector of the null space of the constraints (number of documents and
number of words) until one is 0 or 1. With two constraints three documents always suffice for a step,
and two are left at the end. Blocks of a source are balanced side by side; what each leaves goes to
the next round, until a last handful per source is rounded to the nearest total (landing).

Sizes are numbers of words; a null text has size 0. Documents of size 0 take part in the number of
documents, and take no words. A source without words has target 0. Null sources are one source, the
last. Rows with equal ids are decided each.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.llm.common import WORD, stored

#: Documents per block of the first round and left-over documents per block of later ones.
BLOCK = 8192
#: Probabilities this close to 0 or 1 are there.
TINY = 1e-9
#: Documents of a source kept back for the landing, which tries all ways to round them.
LANDING = 10


def size(text: Column) -> Column:
    """Number of words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(totals: dict, weights: tuple[float, ...], amount: float, most: float) -> dict:
    """Target of each source (key: its size) by weight, at most ``most`` times its size, the excess reshared.

    Sources weigh as ``weights``, repeating, by code point of their names; null comes last.
    """
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets, free, left = {}, set(names), float(amount)
    while free:
        whole = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / whole > most * totals[s]}
        if not above:
            return targets | {s: left * weight[s] / whole for s in free}
        targets |= {s: most * float(totals[s]) for s in above}
        left -= sum(targets[s] for s in above)
        free -= above
    return targets


def flight(probabilities: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Move probabilities to 0 or 1 keeping their sum and that of their products with the sizes; two at most stay."""
    p = [min(max(float(x), 0.0), 1.0) for x in probabilities]
    w = [float(x) for x in sizes]
    open_: list[int] = []
    for i in range(len(p)):
        if TINY < p[i] < 1 - TINY:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            # The vector with sum 0 and sum of products with the sizes 0.
            v = (w[b] - w[c], w[c] - w[a], w[a] - w[b])
            if v == (0.0, 0.0, 0.0):
                v = (1.0, -1.0, 0.0)
            step = min((1 - p[j]) / x if x > 0 else -p[j] / x for j, x in zip(open_, v) if x)
            for j, x in zip(open_, v):
                p[j] += step * x
            open_ = [j for j in open_ if TINY < p[j] < 1 - TINY]
    return np.array([0.0 if x <= TINY else 1.0 if x >= 1 - TINY else x for x in p])


def landing(probabilities: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Round the last probabilities, of all ways the one whose words and documents come nearest to their sums."""
    ways = np.array(list(product((0.0, 1.0), repeat=len(sizes))))
    words = np.abs(ways @ sizes - probabilities @ sizes)
    documents = np.abs(ways.sum(axis=1) - probabilities.sum())
    return ways[np.argmin(words + documents * sizes.mean() / 100)]


def _round(open_: DataFrame, last: bool) -> DataFrame:
    """Fly every block; where it is the last of its source, land it together with a few documents kept back."""

    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "size"], kind="stable", ignore_index=True)
        p, sizes = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(float)
        kept = min(LANDING, len(p)) if last else 0
        p[kept:] = flight(p[kept:], sizes[kept:])
        left = np.flatnonzero((p > 0) & (p < 1))
        if last and len(left):
            p[left] = landing(p[left], sizes[left])
        return rows.assign(p=p)

    return open_.groupBy("source", "block").applyInPandas(fly, open_.schema)


def choose(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, p) with p rounded to 0 or 1, balanced within each source."""
    order = F.xxhash64("doc_id", "size")
    rows = rows.withColumn("order", order)
    done = rows.where(~F.col("p").between(TINY, 1 - TINY)).withColumn("p", F.round("p"))
    open_ = rows.where(F.col("p").between(TINY, 1 - TINY))
    blocks = {r["source"]: -(-r["n"] // BLOCK) for r in open_.groupBy("source").agg(F.count("*").alias("n")).collect()}
    salt = 0
    while True:
        spark, most = rows.sparkSession, max(blocks.values(), default=1)
        counts = spark.createDataFrame(list(blocks.items()), f"_s {rows.schema['source'].dataType.simpleString()}, _n bigint")
        dealt = open_.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("_s"))).withColumn(
            "block", F.pmod(F.xxhash64("order", F.lit(salt)), F.col("_n"))
        )
        flown = stored(_round(dealt.drop("_s", "_n"), most <= 1).drop("block"), "cube")
        done = done.unionByName(flown.where("p IN (0, 1)"))
        if most <= 1:
            return done.drop("order")
        open_, salt = flown.where("p NOT IN (0, 1)"), salt + 1
        # A block leaves two documents at most, so the numbers shrink by thousands.
        blocks = {s: -(-2 * n // BLOCK) for s, n in blocks.items()}


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), amount: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document.

    ``amount`` times all words are shared among the sources; a document is taken at most
    ``ceil(most)`` times. Sources are few: a row for each goes through the driver.
    """
    rows = stored(docs.select("doc_id", "source", size(F.col("text")).alias("size")), "sizes")
    totals = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = shares(totals, weights, amount * sum(totals.values()), most)
    ratios = [(s, int(totals[s]), float(t), t / totals[s] if totals[s] else 0.0) for s, t in targets.items()]
    kind = rows.schema["source"].dataType.simpleString()
    known = rows.sparkSession.createDataFrame(ratios, f"_s {kind}, source_size bigint, target double, ratio double")
    known = F.broadcast(known)
    same = F.col("source").eqNullSafe(F.col("_s"))
    probable = rows.join(known, same).select("doc_id", "source", "size", (F.col("ratio") - F.floor("ratio")).alias("p"))
    chosen = choose(probable).join(known, same)
    copies = (F.floor("ratio") + F.col("p")).cast("long")
    return chosen.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
