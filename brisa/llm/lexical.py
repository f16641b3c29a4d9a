"""Ranked lexical search with no random access (NRA) over impact-sorted posting lists.

Terms are maximal runs of ASCII letters and digits and of any other characters than ASCII ones; only A-Z are lower-cased.
Documents are read once into rows of (document, length, terms, occurrences), for the terms that are asked for; one
aggregation gives the collection's figures. The index is then searched in shards of documents: within a shard every term has a list sorted
by impact, highest first. The lists of an item are read from the top, block by block. A document's score lies between the sum of the
impacts read for it and that sum plus the next unread impact of every list it was not met in. Documents whose upper end is
below the k-th highest lower end are out; reading goes on until all others have one value, so that membership, ties
and scores are exact. A task's later shards start from the k-th score of its earlier ones, and sends on k documents per item.

The terms of the items go to every task, so items are taken in blocks of at most ``ITEM_CHARS`` characters or one item; each block
reads the documents once.

Every row of the documents and of the items counts for itself, also those that repeat an id or have none; a null id comes before
all others. Null and empty texts have no terms: such documents count for nothing, such items get no rows. Empty tables give no rows.
Further columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brisa.llm.common import stored, text_bytes

#: Documents of a shard.
SHARD = 1 << 15
#: Postings read from every list at first; each round reads twice as many.
BLOCK = 64
#: Characters of items whose terms are searched together.
ITEM_CHARS = 1 << 22
#: Parts that an item's candidates are first ranked in.
PARTS = 32
NULL_ID = -(1 << 63)

#: Fixed value: bytes as terms see them. Letters A-Z become small, what is in no term a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): the number of all terms of each document, and how often those asked for occur."""

    def run(batches):
        from collections import Counter

        wanted = numbers.keys()
        for batch in batches:
            data, places = text_bytes(batch.column(1))
            sizes, terms, counts, ends = [], [], [], [0]
            for i in range(batch.num_rows):
                words = terms_of(data[places[i] : places[i + 1]].tobytes())
                sizes.append(len(words))
                found = Counter(words)
                for word in found.keys() & wanted:
                    terms.append(numbers[word])
                    counts.append(found[word])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def weights(index: DataFrame, asked: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the weight of each term asked for."""
    number, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(asked, np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[row["term"]] = row["count"]
    weight = [math.floor(1000 * math.log((2 * number + 2) / (2 * df + 1))) for df in holding.tolist()]
    return number, total, np.array(weight, np.int64)


class Lists:
    """Impact-sorted posting lists of the documents of one shard."""

    def __init__(self, ids, n, terms, counts, lengths, number: int, total: int, weight: np.ndarray):
        m = 10 + (90 * n * number) // total
        owner = np.repeat(np.arange(len(n)), lengths)
        impact = weight[terms] * ((10**9 * counts) // (1000 * counts + 8 * m[owner]))
        order = np.lexsort((-impact, terms))
        self.ids, self.document, self.impact = ids, owner[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weight) + 1))

    def best(self, asked: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents, and their scores, of those that score ``floor`` or more, which is above 0."""
        at, end = self.starts[asked].copy(), self.starts[asked + 1]
        some = np.flatnonzero(at < end)
        at, end = at[some], end[some]
        lower = np.zeros(len(self.ids), np.int64)
        seen = np.zeros((len(some), len(self.ids)), bool)
        alive, block = np.arange(len(self.ids)), BLOCK
        while True:
            stop = np.minimum(at + block, end)
            for i, (a, b) in enumerate(zip(at.tolist(), stop.tolist())):
                lower[self.document[a:b]] += self.impact[a:b]
                seen[i, self.document[a:b]] = True
            at, block = stop, block * 2
            unread = at < end
            upper = lower[alive].copy()
            for i in np.flatnonzero(unread):
                upper += np.where(seen[i, alive], 0, self.impact[at[i]])
            if len(alive) >= k:
                floor = max(floor, int(np.partition(lower[alive], -k)[-k]))
            keep = upper >= floor
            alive, upper = alive[keep], upper[keep]
            if (upper == lower[alive]).all():
                break
        first = np.lexsort((self.ids[alive], -lower[alive]))[:k]
        return self.ids[alive[first]], lower[alive[first]]


def _searched(index: DataFrame, items: list[np.ndarray], k: int, number: int, total: int, weight: np.ndarray) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item."""

    def merged(best, lists):
        for item, asked in enumerate(items):
            ids, scores = best[item]
            floor = max(1, int(scores[-1])) if len(scores) == k else 1
            found, values = lists.best(asked, k, floor)
            ids, scores = np.concatenate([ids, found]), np.concatenate([scores, values])
            first = np.lexsort((ids, -scores))[:k]
            best[item] = ids[first], scores[first]

    def shard(held):
        ids, n, terms, counts, lengths = (np.concatenate([h[i] for h in held]) for i in range(5))
        return Lists(ids, n, terms, counts, lengths, number, total, weight)

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        held, count = [], 0
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3)]
            held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), *flat, lengths))
            count += batch.num_rows
            if count >= SHARD:
                merged(best, shard(held))
                held, count = [], 0
        if held:
            merged(best, shard(held))
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(b[0]) for b in best])
        ids, scores = (np.concatenate([b[i] for b in best]) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    matching = index.where(F.size("terms") > 0).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    return matching.mapInArrow(run, "item int, doc_id bigint, score bigint")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """Results of the items in ``rows``, (item_id, text)."""
    numbers: dict[bytes, int] = {}
    items, ids = [], []
    for row in rows:
        asked = [numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(terms_of(row["text"].encode()))]
        if asked:
            items.append(np.array(asked))
            ids.append(row["item_id"])
    if not items:
        return None
    index = stored(postings(docs, numbers), "postings")
    number, total, weight = weights(index, len(numbers))
    if not number:
        return None
    found = _searched(index, items, k, number, total, weight)
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)).alias("part")
    found = _first(found.select("*", part), ["item", "part"], k).drop("rank")
    found = _first(found, ["item"], k).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents above 0 for each item, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    asked = items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // ITEM_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    found = [_block(docs, asked.where(block == i).collect(), k) for i in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)
