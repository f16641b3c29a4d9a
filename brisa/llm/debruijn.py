"""Removing repeated stretches of words, by runs of word windows in place of a compacted de Bruijn graph.

There is no graph: no (k-1)-word nodes, degrees or joins that compact paths (the README says why). Windows of ``length`` words that follow
each other and share their anchor (the two longest neighbouring words in them, see anchors.py) are one run, which corresponds to
a path that is compacted where it is read; a row stands for it. Sorting brings equal runs of all documents together and settles them; runs
that share an anchor only are taken apart into their windows, which meet once more by content.
What is repeated comes back as source coordinates (document, first word, end), and adjoining
runs of a document make maximal spans, which are cut from the words at these coordinates.

A window counts as repeated if it also starts in a document of smaller id; the first document keeps it.
Ids are unique; rows that repeat an id are cut alike, and a null id counts as the smallest. A null text has no
words. Texts shorter than ``length`` words stay whole.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.anchors import RUN, RUN_SCHEMA, Rolling, batch_of, by_document, digests, merged, resolve, runs, segments, spread_known
from brisa.llm.common import mixed, stored
from brisa.llm.suffix import NULL_ID, keyed
from brisa.llm.tokens import kept_by_worker


#: Words of the anchor gram.
GRAM = 2
#: Words whose digests a worker remembers.
REMEMBERED = 1 << 19


def word_digests(words: list[bytes]) -> np.ndarray:
    """64 bits of a cryptographic hash of each word. Workers remember those of short ones."""
    known = kept_by_worker("word digests", dict)
    if len(known) > REMEMBERED:
        known.clear()
    found = []
    for word in words:
        digest = known.get(word)
        if digest is None:
            digest = blake2b(word, digest_size=8).digest()
            if len(word) < 32:
                known[word] = digest
        found.append(digest)
    return np.frombuffer(b"".join(found), np.uint64)


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and number of bytes of every word of a column, and the number of words per text."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(lists.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = word_digests(words)
    there = sizes[codes] > 0 if len(codes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)[there]
    codes = codes[there]
    return hashes[codes], sizes[codes], np.bincount(owner, minlength=len(counts)).astype(np.int64)


def rank_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rank of every word with the one after it as an anchor: long ones first, as they are rare."""
    pair, letters = hashes.copy(), sizes.copy()
    pair[:-1] = mixed(pair[:-1] * np.uint64(3) + hashes[1:])
    letters[:-1] += sizes[1:]
    return (np.uint64(255) - np.minimum(letters, 255).astype(np.uint64)) << np.uint64(32) | mixed(pair) >> np.uint64(32)


def paths(docs: DataFrame, length: int) -> DataFrame:
    """Compacted paths of the windows of every document, as runs."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, letters, counts = word_units(batch.column(1))
            rank = rank_of(hashes, letters)
            starts = np.cumsum(counts) - counts
            for group in segments(counts, length):
                where = np.concatenate([np.arange(starts[t] + a, starts[t] + b) for t, a, b in group])
                sizes = np.array([b - a for _, a, b in group])
                units = hashes[where]
                stretch, a, n, x, g, c = runs(units, units, rank[where], sizes, length, GRAM)
                doc = ids[np.array([t for t, _, _ in group])[stretch]]
                a = a + np.array([s for _, s, _ in group])[stretch]
                g, x = spread_known(g, c, doc, a, x, "document")
                yield batch_of(dict(g=g, c=c, doc=doc, a=a, n=n, x=x), RUN_SCHEMA)

    return docs.mapInArrow(run, RUN)


def edges(docs: DataFrame, closer: DataFrame, length: int) -> DataFrame:
    """The single windows of paths, keyed by their content."""
    wanted = closer.groupBy("doc").agg(F.collect_list(F.struct("a", "n")).alias("runs"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, _, counts = word_units(batch.column(1))
            lists = batch.column(2)
            fields = lists.flatten()
            a, n = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.cumsum(counts) - counts
            row, first = np.repeat(owner, n), np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            whole = first + length <= counts[row]
            row, first = row[whole], first[whole]
            bounds = np.searchsorted(row, np.arange(len(counts) + 1))
            for t in np.unique(row):
                at = first[bounds[t] : bounds[t + 1]]
                # A text of any length is hashed in stretches around its windows.
                for low in range(0, int(counts[t]), 1 << 19):
                    some = at[(at >= low) & (at < low + (1 << 19))]
                    if not len(some):
                        continue
                    units = hashes[starts[t] + low : starts[t] + min(counts[t], low + (1 << 19) + length)]
                    g, c = Rolling(units).of(some - low, some - low + length), digests(units, some - low, some - low + length)
                    one = np.ones(len(some))
                    yield batch_of(dict(g=g, c=c, doc=np.full(len(some), ids[t]), a=some, n=one, x=one), RUN_SCHEMA)

    return docs.join(wanted, "doc").mapInArrow(run, RUN)


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """Spans (doc, start, end) of words in windows that also start in a document of smaller id; they may overlap."""
    level = stored(resolve(paths(docs, length), "document").select("doc", "a", "n", "closer"), "paths")
    single = resolve(edges(docs, level.where("closer"), length), "document")
    found = level.where("NOT closer").select("doc", "a", "n").unionByName(single.select("doc", "a", "n"))
    return found.select("doc", F.col("a").alias("start"), (F.col("a") + F.col("n") - 1 + length).alias("end"))


CUT = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
)


@F.arrow_udf(CUT)
def _cut(column: pa.Array, spans: pa.Array) -> pa.Array:
    lists = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fields = spans.flatten()
    start, end = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    ends = np.cumsum(lists)
    rows = []
    for i, text in enumerate(column.cast(pa.large_binary())):
        words = text.as_buffer().to_pybytes().split()
        a, b = merged(start[ends[i] - lists[i] : ends[i]], end[ends[i] - lists[i] : ends[i]], len(words))
        a, b = a[a < b].tolist(), b[a < b].tolist()
        kept = words if not a else [w for x, y in zip([0, *b], [*a, len(words)]) for w in words[x:y]]
        rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.name for f in CUT])


def without_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document with the words it keeps, joined by one space.

    All windows are judged on the input, not on what is left.
    """
    known = keyed(docs)
    cut = known.join(by_document(repeated(known, length)), "doc", "left").select("doc", _cut("text", "spans").alias("cut"))
    return cut.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "cut.*")
