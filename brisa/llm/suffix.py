"""Removing repeated stretches of bytes by longest-previous-factor arrays.

In suffix order, suffixes that share their first bytes stand side by side; the previous and next smaller
positions around a suffix tell the longest stretch that occurs earlier (its longest previous factor),
the neighbours the other way whether it occurs elsewhere at all. A stretch of ``length`` bytes goes if its
factor is that long.

One suffix array of a corpus does not fit one task, so suffixes meet by content: windows of ``length``
bytes are cut into runs by their anchors (see anchors.py), runs of equal content are settled by sorting, and only
runs that share an anchor but not their content, which surround the ends of repeated passages, go on with
their bytes. Those of one anchor form a small text whose suffix array, to the depth that
matters, is built by doubling in one task. An anchor with more than ``HOT`` runs, as at the ends of
a passage that very many documents share, is split by longer parts of the content until single windows remain,
each step exact, so no task holds such a group.

Ids are unique; rows that repeat an id are cut alike, and a null id counts as the smallest. A null text
counts as empty. Texts shorter than ``length`` bytes have no repeats and stay whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.anchors import (
    RUN,
    RUN_SCHEMA,
    SEGMENT,
    Rolling,
    batch_of,
    by_document,
    digests,
    merged,
    resolve,
    runs,
    segments,
    spread_known,
)
from brisa.llm.common import mixed, partitions, stored, text_bytes

#: Bytes of the anchor gram.
GRAM = 32
#: Runs of one anchor whose suffix array one task builds.
HOT = 512
#: Windows of a split run.
SPLIT = 16
#: Bytes whose suffix array a task builds at a time.
CHUNK = 1 << 21
NULL_ID = -(1 << 63)

SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text): ids without nulls, texts without nulls."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )


def spread_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes as units of a rolling hash."""
    return mixed(data.astype(np.uint64) + np.uint64(1))


def byte_runs(docs: DataFrame, length: int, rule: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, places = text_bytes(batch.column(1))
            for group in segments(np.diff(places), length):
                raw = np.concatenate([data[places[t] + a : places[t] + b] for t, a, b in group])
                sizes = np.array([b - a for _, a, b in group])
                stretch, a, n, x, g, c = runs(raw, spread_bytes(raw), None, sizes, length, GRAM)
                doc = ids[np.array([t for t, _, _ in group])[stretch]]
                a = a + np.array([s for _, s, _ in group])[stretch]
                g, x = spread_known(g, c, doc, a, x, rule)
                yield batch_of(dict(g=g, c=c, doc=doc, a=a, n=n, x=x), RUN_SCHEMA)

    return docs.mapInArrow(run, RUN)


def run_bytes(docs: DataFrame, closer: DataFrame, length: int) -> DataFrame:
    """Runs with their bytes: (g, doc, a, n, x, bytes)."""
    wanted = closer.groupBy("doc").agg(F.collect_list(F.struct("g", "a", "n", "x")).alias("runs"))

    def run(batches):
        for batch in batches:
            data, places = text_bytes(batch.column(1))
            lists = batch.column(2)
            fields = lists.flatten()
            g, a, n, x = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, end = places[owner] + a, places[owner] + a + n - 1 + length
            whole = end <= places[owner + 1]
            docs_ = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            rows = np.flatnonzero(whole)
            for i in range(0, len(rows), 4096):
                at = rows[i : i + 4096]
                values = pa.array([data[s:e].tobytes() for s, e in zip(start[at], end[at])], pa.binary())
                columns = [pa.array(v[at]) for v in (g, docs_, a, n, x)] + [values]
                yield pa.RecordBatch.from_arrays(columns, ["g", "doc", "a", "n", "x", "bytes"])

    return docs.join(wanted, "doc").mapInArrow(run, "g bigint, doc bigint, a bigint, n int, x int, bytes binary")


def suffix_classes(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Rank of each of the given suffixes among all by their first ``length`` bytes; equal ones share it.

    Prefix doubling: the rank of twice the depth comes from the ranks at a place and one depth on.
    """
    padded = np.concatenate([data, np.zeros(2 * length + 8, np.uint8)]).astype(np.uint64)
    count, depth = len(data) + length, 8
    key = np.zeros(count, np.uint64)
    for i in range(depth):
        key = (key << np.uint64(8)) | padded[i : i + count]
    if length < depth:
        key, depth = key >> np.uint64(8 * (depth - length)), length
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while depth * 2 <= length:
        pair = rank[:-depth] * (len(rank) + 1) + rank[depth:]
        rank, depth = np.unique(pair, return_inverse=True)[1].astype(np.int64), depth * 2
    rest = length - depth
    return rank[places] * (len(rank) + 1) + rank[places + rest]


def factors(data, sizes, group, doc, a, n, length: int, rule: str):
    """Spans (doc, start, end) of bytes in repeated windows of runs, the runs of a group being one text.

    Windows stand in suffix order, equal ones by position: the one before is then the previous smaller position with a
    common prefix of ``length`` (the longest previous factor is that long), the one after the next.
    """
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    class_ = suffix_classes(data, starts[owner] + offset, length)
    at = a[owner] + offset
    order = np.lexsort((at, doc[owner], class_, group[owner]))
    same = (np.diff(class_[order]) == 0) & (np.diff(group[owner][order]) == 0)
    before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
    out = np.zeros(len(owner), bool)
    out[order] = before if rule == "first" else before | after
    hit = np.flatnonzero(out)
    new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]) if len(hit) else np.zeros(0, bool)
    head = hit[new]
    tail = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
    return doc[owner[head]], at[head], at[tail] + length


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [v.as_buffer() for v in column]
    sizes = np.array([v.size for v in values], np.int64)
    return np.frombuffer(b"".join(v.to_pybytes() for v in values), np.uint8), sizes


def _spans_of_groups(texts_: DataFrame, length: int, rule: str) -> DataFrame:
    def run(batches):
        held, size = [], 0

        def give(table):
            data, sizes = _joined(table.column("bytes").combine_chunks())
            g, doc, a, n = (table.column(k).to_numpy() for k in ("g", "doc", "a", "n"))
            doc, start, end = factors(data, sizes, g, doc, a, n, length, rule)
            if len(doc):
                yield batch_of(dict(doc=doc, start=start, end=end), SPAN)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                new = np.flatnonzero(g[1:] != g[:-1])
                if len(new):
                    cut = int(new[-1]) + 1
                    yield from give(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from give(pa.Table.from_batches(held))

    dealt = texts_.repartition(partitions(texts_.sparkSession), "g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "doc bigint, start bigint, end bigint")


def _some(batches):
    """Rows of batches in groups that one rolling hash can hold."""
    for batch in batches:
        sizes = np.array([v.as_buffer().size for v in batch.column("bytes")], np.int64)
        start, total = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if total + s > SEGMENT:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += s
        if start < len(sizes):
            yield batch.slice(start)


def _split_runs(texts_: DataFrame, length: int) -> DataFrame:
    """Runs of at most SPLIT windows, at places counted from the anchor, keyed by what all such windows share."""

    def run(batches):
        for batch in _some(batches):
            data, sizes = _joined(batch.column("bytes"))
            doc, a, n, x = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc", "a", "n", "x"))
            starts = np.cumsum(sizes) - sizes
            first = Rolling(spread_bytes(data))
            owner = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            block = (x[owner] - offset) // SPLIT
            new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(block) != 0)])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(owner)))
            owner, offset, block = owner[at], offset[at], block[at]
            shared = starts[owner] + x[owner] - SPLIT * block
            g = first.of(shared, shared - SPLIT + 1 + length) ^ mixed(block.astype(np.uint64))
            begin = starts[owner] + offset
            shape = mixed(((shared - begin) << 20 | count).astype(np.uint64))
            content = digests(data, begin, begin + count - 1 + length) ^ shape
            columns = dict(g=g, c=content, doc=doc[owner], a=a[owner] + offset, n=count, x=offset)
            yield batch_of(columns, RUN_SCHEMA)

    return texts_.mapInArrow(run, RUN)


def _windows(texts_: DataFrame, closer: DataFrame, length: int) -> DataFrame:
    """Single windows of runs, keyed by their content."""
    parts = closer.select("doc", (F.col("a") - F.col("x")).alias("a"), F.struct(F.col("x").alias("at"), F.col("n").alias("count")).alias("part"))
    wanted = parts.groupBy("doc", "a").agg(F.collect_set("part").alias("parts"))

    def run(batches):
        for batch in _some(batches):
            data, sizes = _joined(batch.column("bytes"))
            doc, a = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "a"))
            lists = batch.column("parts")
            fields = lists.flatten()
            row = np.repeat(np.arange(len(doc)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, count = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            row, offset = np.repeat(row, count), np.repeat(at, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            begin = (np.cumsum(sizes) - sizes)[row] + offset
            g, c = Rolling(spread_bytes(data)).of(begin, begin + length), digests(data, begin, begin + length)
            one = np.ones(len(row))
            yield batch_of(dict(g=g, c=c, doc=doc[row], a=a[row] + offset, n=one, x=one), RUN_SCHEMA)

    return texts_.select("doc", "a", "bytes").join(wanted, ["doc", "a"]).mapInArrow(run, RUN)


def _spans(found: DataFrame, length: int) -> DataFrame:
    return found.where("NOT closer").select("doc", F.col("a").alias("start"), (F.col("a") + F.col("n") - 1 + length).alias("end"))


def repeated(docs: DataFrame, length: int, rule: str) -> DataFrame:
    """Spans (doc, start, end) of bytes in windows of ``length`` bytes that are elsewhere too ("other") or earlier ("first").

    Earlier means in a document of smaller id, or before in the same one. Spans may overlap.
    """
    level = stored(resolve(byte_runs(docs, length, rule), rule).drop("c"), "byte-runs")
    closer = level.where("closer").select("g", "doc", "a", "n", "x")
    near = stored(run_bytes(docs, closer, length), "run-bytes")
    hot = stored(near.groupBy("g").count().where(F.col("count") > HOT).select("g"), "hot")
    found = _spans(level, length)
    if hot.isEmpty():
        return found.unionByName(_spans_of_groups(near, length, rule))
    found = found.unionByName(_spans_of_groups(near.join(hot, "g", "left_anti"), length, rule))
    large = stored(near.join(hot, "g", "left_semi"), "run-bytes")
    split = stored(resolve(_split_runs(large, length), rule), "byte-runs")
    single = resolve(_windows(large, split.where("closer"), length), rule)
    return found.unionByName(_spans(split, length)).unionByName(_spans(single, length))


CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _whole_characters(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole characters of UTF-8."""
    padded = np.append(text, 0)
    for _ in range(3):
        a = a + ((padded[np.minimum(a, len(text))] & 0xC0) == 0x80)
        b = b - ((padded[b] & 0xC0) == 0x80)
    return a[a < b], b[a < b]


def _bytes_of_words(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words as spans of bytes, from the first one's first byte to the last one's last."""
    inner = np.concatenate([[False], (text != 32) & ((text < 9) | (text > 13)), [False]])
    edge = np.diff(inner.astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return first[start], last[np.minimum(end, len(last)) - 1]


def cut(text: Column, spans: Column, characters: bool = False) -> Column:
    """Struct of n_bytes, n_removed, n_spans and the kept bytes of a text without its spans (start, end).

    Spans with the field ``words`` set count words, not bytes. With ``characters`` a character that a span holds in part stays, so what is kept is text again.
    """

    @F.arrow_udf(CUT)
    def run(column: pa.Array, spans: pa.Array) -> pa.Array:
        data, places = text_bytes(column)
        lists = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fields = spans.flatten()
        start, end = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        words = fields.field(2).to_numpy(zero_copy_only=False) if fields.type.num_fields > 2 else np.zeros(len(start), bool)
        ends = np.cumsum(lists)
        rows = []
        for i in range(len(column)):
            text = data[places[i] : places[i + 1]]
            own = slice(ends[i] - lists[i], ends[i])
            a, b, w = start[own], end[own], words[own].astype(bool)
            if w.any():
                x, y = _bytes_of_words(text, a[w], b[w])
                a, b = np.concatenate([a[~w], x]), np.concatenate([b[~w], y])
            a, b = merged(a, b, len(text))
            a, b = a[a < b], b[a < b]
            if characters and len(a):
                a, b = _whole_characters(text, a, b)
            if len(a):
                kept = b"".join(text[x:y].tobytes() for x, y in zip(np.append(0, b), np.append(a, len(text))))
            else:
                kept = text.tobytes()
            rows.append((len(text), len(text) - len(kept), len(a), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.name for f in CUT])

    return run(F.coalesce(text, F.lit("")), spans)


def cut_documents(
    docs: DataFrame, length: int = 400, rule: str = "first", characters: bool = False, words: int | None = None
) -> DataFrame:
    """(row, cut): the documents, each with all its columns in ``row``, and n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes).

    ``rule`` "first" keeps the first place of a repeated stretch, "other" none. All stretches are
    judged on the input. With ``words``, so many words that a document of smaller id holds in a row go too, however few
    bytes they have. Columns besides doc_id and text may have any names.
    """
    spans, fields = repeated(keyed(docs), length, rule), ("start", "end")
    if words is not None:
        from brisa.llm import debruijn

        both = [spans.withColumn("words", F.lit(False)), debruijn.repeated(keyed(docs), words).withColumn("words", F.lit(True))]
        spans, fields = both[0].unionByName(both[1]), (*fields, "words")
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.struct("*").alias("row"))
    found = whole.join(by_document(spans, fields), "doc", "left")
    return found.select("row", cut(F.col("row.text"), F.col("spans"), characters).alias("cut"))


def without_repeats(docs: DataFrame, length: int = 400, rule: str = "first", **how) -> DataFrame:
    """The same with the documents' columns and the struct ``cut_``, which gets further underscores if they have that column."""
    name = "cut_"
    while name in docs.columns:
        name += "_"
    return cut_documents(docs, length, rule, **how).select("row.*", F.col("cut").alias(name))
