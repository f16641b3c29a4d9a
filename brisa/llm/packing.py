"""Best-fit packing of token sequences, planned over a histogram of lengths.

Only the number of pieces of each length reaches the plan (at most ``capacity`` numbers), which fills
sequences best-fit, longest first, many equal ones at a time. The plan lists, for each length, which
ranks go to which sequences at which place; pieces take their slots by joining on their rank within
their length. No document passes the driver.

A null text counts as empty and gives a piece of the end token alone. Repeated rows are packed each.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm.common import stored, texts
from brisa.llm.ranks import ranked
from brisa.llm.tokens import token_ids

#: Ranks of a length are joined in steps of this many, so a piece meets few rows of the plan.
STEP = 4096


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts as ids and the end token, cut if longer than capacity.

    All pieces of a cut document but the first are full.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1), vocabulary)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(["doc_id", "piece", "start", "length", "ids_crc32"], kinds)))
    return texts(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each): best fit of all lengths, longest first.

    Sequences with the same contents are one entry, so the work grows with the number of lengths and
    not of pieces.
    """
    open_by_room: dict[int, list] = {}
    rooms: list[int] = []

    def put(room, entry):
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append(entry)

    def take(room):
        entry = open_by_room[room].pop()
        if not open_by_room[room]:
            del open_by_room[room]
            rooms.remove(room)
        return entry

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            available, held = take(room) if at < len(rooms) else (left, ())
            each = room // length
            full = min(available, left // each)
            if full:
                put(room - each * length, (full, held + (length,) * each))
                left -= full * each
                available -= full
            if available and 0 < left < each:
                put(room - left * length, (1, held + (length,) * left))
                left, available = 0, available - 1
            if available and held:
                put(room, (available, held))
    return [entry for room in rooms for entry in open_by_room[room]]


def slots(planned: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank beyond the last, first sequence, offset) of all places of a plan."""
    rows, given, sequence = [], {}, 0
    for count, lengths in planned:
        offset = 0
        for length in lengths:
            first = given.get(length, 0)
            rows.append((length, first, first + count, sequence, offset))
            given[length] = first + count
            offset += length
        sequence += count
    return rows


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).

    The plan's rows are bounded by the capacity. Its stretches of ranks are cut into steps, a row for
    some thousand pieces, so the join has small groups; Spark chooses how to join.
    """
    spark = cut.sparkSession
    cut = stored(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = spark.createDataFrame(
        slots(plan(counts, capacity)), "slot_length bigint, low bigint, high bigint, first bigint, offset bigint"
    )
    steps = F.sequence(F.floor(F.col("low") / STEP), F.floor((F.col("high") - 1) / STEP))
    places = places.withColumn("step", F.explode(steps))
    taken = ranked(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank")
    fits = (
        (F.col("length") == F.col("slot_length"))
        & (F.floor(F.col("rank") / STEP) == F.col("step"))
        & (F.col("rank") >= F.col("low"))
        & (F.col("rank") < F.col("high"))
    )
    return taken.join(places, fits).select(
        *cut.columns, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, vocabulary, capacity, end), capacity)
