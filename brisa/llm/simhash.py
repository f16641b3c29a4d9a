"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits.

Fingerprints are cut into blocks; two within the distance agree in all blocks but as many as the
distance, so each combination of the other blocks is a join key, and the exact distance decides.
Equal fingerprints are one before the join, and of a large bucket only links that span its
components are given. Buckets beyond ``BUCKET`` members are cut anew with more blocks; what is
still larger after the finest cut is compared in tiles, so nothing is dropped.

A null text counts as empty; texts without words have fingerprint 0 and link like any other.
Null ids are kept; a component of null ids alone has a null id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.common import partitions, stored, texts
from brisa.llm.components import components

#: A-Z to a-z, and the seed of the shingle hash.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Shingles hashed at a time, which bounds the memory whatever the length of a text.
STEP = 1 << 16
#: Members of a bucket that one task compares with each other.
BUCKET = 2048
#: Rows of sorted keys handled at a time.
ROWS = 1 << 18


def fingerprint(text: bytes, size: int) -> int:
    """64-bit fingerprint: a bit is 1 if over half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    count, ones = len(last), np.zeros(64, np.int64)
    for at in range(0, count, STEP):
        spans = zip(starts[at : at + STEP].tolist(), last[at : at + STEP].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fingerprint) with the 64 bits as a long."""

    @F.arrow_udf(T.LongType())
    def mark(column: pa.Array) -> pa.Array:
        found = [fingerprint(x.as_buffer().to_pybytes(), size) for x in column.cast(pa.large_binary())]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return texts(docs).select("doc_id", mark("text").alias("fingerprint"))


def _keys(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    """A row per fingerprint and choice of the blocks that must agree: (key, fingerprint)."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(
        *[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)]
    )
    return prints.select("fingerprint", F.explode(choices).alias("k")).select("k.choice", "k.bits", "fingerprint")


def _spanning(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the first of its component, by exact distances within the bucket."""
    n = len(members)
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= distance
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(n))
    return members[at], members[label[at]]


def _bucket_links(choice: np.ndarray, bits: np.ndarray, prints: np.ndarray, distance: int, last: bool):
    """Links within the buckets of sorted rows, and the members of buckets that are too large."""
    change = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(bits)]]))
    a, b, large = [], [], []
    bucket = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= 8, sizes)
    for lag in range(1, 8):
        at = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & small[lag:])
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + lag]) <= distance]
        a.append(prints[at + lag])
        b.append(prints[at])
    for i in np.flatnonzero(sizes > 8):
        members = prints[starts[i] : starts[i] + sizes[i]]
        if sizes[i] > BUCKET and not last:
            large.append(members)
        else:
            x, y = _spanning(members, distance)
            a.append(x)
            b.append(y)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b, large)]


def _bucket_pass(keys: DataFrame, distance: int, last: bool) -> DataFrame:
    """(a, b) links of all buckets; members of too large buckets as (a, null)."""

    def run(batches):
        held: list[tuple] = []
        # The bucket that goes on at the end of what was read and is known to be too large.
        over = None

        def too_large(members):
            # Members of a large bucket come once per bucket; equal rows go in the next step.
            return pa.record_batch([pa.array(members.view(np.int64)), pa.nulls(len(members), pa.int64())], ["a", "b"])

        def give(rows):
            a, b, large = _bucket_links(*rows, distance, last)
            if len(large):
                yield too_large(large)
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows[2] = rows[2].view(np.uint64)
            if over is not None:
                other = np.flatnonzero((rows[0] != over[0]) | (rows[1] != over[1]))
                cut = int(other[0]) if len(other) else len(rows[0])
                if cut:
                    yield too_large(rows[2][:cut])
                if not len(other):
                    continue
                rows, over = [x[cut:] for x in rows], None
            held.append(tuple(rows))
            count += len(rows[0])
            if count >= ROWS:
                choice, bits, prints = (np.concatenate(x) for x in zip(*held))
                new = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield from give((choice[:cut], bits[:cut], prints[:cut]))
                held = [(choice[cut:], bits[cut:], prints[cut:])]
                count = len(choice) - cut
                if count > BUCKET and not last:
                    # Its members go on as they are read, so a task never holds them all.
                    yield too_large(prints[cut:])
                    over, held, count = (choice[-1], bits[-1]), [], 0
        if held:
            yield from give(tuple(np.concatenate(x) for x in zip(*held)))

    n = partitions(keys.sparkSession)
    dealt = keys.repartition(n, "choice", "bits").sortWithinPartitions("choice", "bits", "fingerprint")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _tiles(keys: DataFrame) -> DataFrame:
    """Members of each bucket in pairs of groups, so that every pair meets and no task holds a bucket."""
    sizes = keys.groupBy("choice", "bits").agg(F.ceil(F.count("*") / (BUCKET / 2)).cast("int").alias("groups"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("groups")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other")
    pairs = keys.join(sizes, ["choice", "bits"]).withColumn("own", own).select("*", other)
    tile = F.xxhash64("choice", "bits", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.select(F.lit(0).alias("choice"), tile.alias("bits"), "fingerprint")


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within the distance, each chain of them included."""
    count = prints.count()
    blocks = distance + 2
    # Enough bits in a key that a bucket of unrelated fingerprints stays small.
    while blocks < 16 and count >> (64 * (blocks - distance) // blocks) > 16:
        blocks += 1
    found = None
    for step, size in enumerate((blocks, blocks + 2, blocks + 6)):
        size = min(size, 20)
        keys = _keys(prints, size, distance)
        result = stored(_bucket_pass(keys, distance, False), "simhash")
        good = result.where("b IS NOT NULL")
        found = good if found is None else found.unionByName(good)
        prints = result.where("b IS NULL").select(F.col("a").alias("fingerprint")).distinct()
        if prints.isEmpty():
            return found
    keys = stored(_keys(prints, size, distance), "simhash")
    return found.unionByName(_bucket_pass(_tiles(keys), distance, True))


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Documents are linked where their fingerprints differ in at most ``distance`` bits; the component
    is named by its smallest doc_id. ``size`` is the number of words in a shingle.
    """
    marked = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(distinct.select("fingerprint"), distance)).withColumnsRenamed({"node": "fingerprint"})
    placed = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    names = placed.join(named, "root").select("fingerprint", "component_id")
    return marked.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")
