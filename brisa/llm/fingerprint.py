"""Quartile bucket digests: short codes of texts whose difference tells how alike the texts are.

Byte triplets of a text are hashed into buckets and counted. The digest holds a check byte, the
logarithm of the length, two ratios of the quartiles of the counts, and two bits per bucket: the
quartile its count lies in. Counting keeps the digest steady under local edits.

Nulls count as empty texts. Texts of fewer than four bytes have no triplets, so only check byte and
length tell them apart. Equal texts have equal digests.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.common import partitions, text_bytes, texts

BUCKETS = 256
#: Triplets of a window of four bytes that hold its first byte.
SHAPES = ((1, 2), (1, 3), (2, 3))
SPAN = 4
#: Bytes counted at a time, which bounds the memory whatever the length of a text.
STEP = 1 << 19
DIGEST_BYTES = 3 + BUCKETS // 4
#: Difference of two quartile codes; opposite quartiles weigh double.
CODE_DIFFERENCE = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
#: Largest share of each part of the header in a difference.
MOST_LENGTH, MOST_RATIO = 24, 8
#: A difference of so much, that of digests with independent codes, counts as no likeness at all.
UNLIKE = CODE_DIFFERENCE.mean() * BUCKETS + MOST_LENGTH


def triplet_counts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Counts of hashed triplets, a row of buckets per text."""
    n = len(places) - 1
    counts = np.zeros((n, BUCKETS), np.int64)
    total = int(places[-1])
    for start in range(0, total, STEP):
        end = min(start + STEP, total)
        first = int(np.searchsorted(places, start, "right")) - 1
        last = int(np.searchsorted(places, end, "left"))
        inner = np.clip(places[first : last + 1], start, end)
        owner = np.repeat(np.arange(last - first, dtype=np.int64), np.diff(inner))
        ends = places[first + 1 : last + 1]
        whole = np.arange(start + SPAN, end + SPAN) <= ends[owner]
        at = np.flatnonzero(whole)
        owner = owner[at] * BUCKETS
        window = data[start : end + SPAN].astype(np.uint32)
        head = window[at] << np.uint32(16)
        for salt, (i, j) in enumerate(SHAPES):
            triplet = head | (window[at + i] << np.uint32(8)) | window[at + j]
            bucket = ((triplet + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(24)
            found = np.bincount(owner + bucket, minlength=(last - first) * BUCKETS)
            counts[first:last] += found.reshape(-1, BUCKETS)
    return counts


def digests(column: pa.Array) -> np.ndarray:
    """Digests of a column of texts, a row of bytes per text."""
    data, places = text_bytes(column)
    counts = triplet_counts(data, places)
    lengths = np.diff(places)
    ordered = np.sort(counts, axis=1)
    low, middle, high = (ordered[:, BUCKETS * k // 4 - 1, None] for k in (1, 2, 3))
    codes = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    out = np.zeros((len(lengths), DIGEST_BYTES), np.uint8)
    out[:, 0] = [zlib.crc32(data[a:b]) & 255 for a, b in zip(places[:-1], places[1:])]
    out[:, 1] = np.minimum(np.log2(lengths + 1) * 8, 255).astype(np.uint8)
    top = np.maximum(high[:, 0], 1)
    out[:, 2] = (low[:, 0] * 15 // top) * 16 + middle[:, 0] * 15 // top
    out[:, 3:] = codes.reshape(len(lengths), -1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return out


def _byte_differences() -> np.ndarray:
    fields = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
    return CODE_DIFFERENCE[fields[:, None, :], fields[None, :, :]].sum(axis=2).astype(np.uint8)


_DIFFERENCES = _byte_differences()


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences of digests, row by row; 0 for equal ones."""
    wide_a, wide_b = a.astype(np.int64), b.astype(np.int64)
    length = np.minimum(np.abs(wide_a[:, 1] - wide_b[:, 1]), MOST_LENGTH)
    ratio = sum(
        np.minimum(np.abs((wide_a[:, 2] >> shift & 15) - (wide_b[:, 2] >> shift & 15)), MOST_RATIO) for shift in (0, 4)
    )
    return _DIFFERENCES[a[:, 3:], b[:, 3:]].sum(axis=1, dtype=np.int64) + length + ratio + (a[:, 0] != b[:, 0])


def _from_hex(column: pa.Array) -> np.ndarray:
    whole = bytes.fromhex("".join(column.to_pylist()))
    return np.frombuffer(whole, np.uint8).reshape(-1, DIGEST_BYTES)


@F.arrow_udf(T.StringType())
def _digest(column: pa.Array) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in digests(column)], pa.string())


@F.arrow_udf(T.DoubleType())
def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    apart = differences(_from_hex(a), _from_hex(b))
    return pa.array(np.maximum(0.0, 1.0 - apart / UNLIKE))


def fingerprint(text: Column) -> Column:
    """Digest of a text as hexadecimal digits."""
    return _digest(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal digests down to 0 for digests as far apart as independent ones."""
    return _likeness(a, b)


def _blocks(docs: DataFrame, count: int):
    """Column function that numbers blocks of about equally many documents, from the largest id down."""
    points = docs.agg(
        F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20 * count).alias("at")
    ).first()["at"]
    bounds = np.unique(np.array(points or [], np.int64))

    @F.arrow_udf(T.IntegerType())
    def block(ids: pa.Array) -> pa.Array:
        place = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
        place[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds) + 1
        return pa.array(place.astype(np.int32), pa.int32())

    return block


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents with ``next_<column>`` of the document that follows in descending doc_id.

    The first follows the last. Null ids come last; rows with equal ids follow by their text.
    Blocks of neighbouring ids are put in order separately; a block ends with a copy of the
    first document of the next one, and only these first ones (one a block) pass the driver's plan.
    """
    block = _blocks(docs, 8 * partitions(docs.sparkSession))
    placed = docs.withColumn("block", block("doc_id"))
    heads = docs.select("doc_id").withColumn("block", block("doc_id")).groupBy("block").agg(F.max("doc_id").alias("id"))
    firsts = [(row["block"], row["id"]) for row in heads.orderBy("block").collect()]
    ends = [(firsts[i - 1][0], id_) for i, (_, id_) in enumerate(firsts)]
    known = [id_ for _, id_ in ends if id_ is not None]
    wanted = F.col("doc_id").isin(known) if known else F.lit(False)
    if len(known) < len(ends):
        wanted = wanted | F.col("doc_id").isNull()
    first = F.min(F.struct("text", *[c for c in columns if c != "text"]))
    copies = placed.where(wanted).groupBy("doc_id").agg(first.alias("first"))
    to = docs.sparkSession.createDataFrame([(b, id_) for b, id_ in ends], "ends_block int, ends_id bigint")
    copies = copies.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("ends_id"))).select(
        "doc_id", *[F.col(f"first.{c}").alias(c) for c in docs.columns if c != "doc_id"], F.col("ends_block").alias("block")
    )
    both = placed.withColumn("tail", F.lit(0)).unionByName(copies.withColumn("tail", F.lit(1)))
    order = Window.partitionBy("block").orderBy("tail", F.col("doc_id").desc_nulls_last(), "text")
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(order))
    return both.where("tail = 0").drop("tail", "block")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Digest of every document, of its edited text and of the next document, with their likeness.

    The edit replaces the last half of the characters by the first as many (or all) of the next
    document's. An empty text stays empty; in a table of one document the next one is itself.
    """
    marked = texts(docs).withColumn("fingerprint", fingerprint(F.col("text")))
    half = F.expr("cast(floor(n_chars / 2) AS int)")
    edited = (
        with_next(marked, ["text", "fingerprint"])
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
