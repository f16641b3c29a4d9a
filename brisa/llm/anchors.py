"""Cutting texts into runs of windows at places that their content decides.

A window is ``length`` consecutive units (bytes or words). Its anchor is the unit gram in it that
comes first in a fixed order (the leftmost of equal ones), so equal windows have equal anchors at the
same place in them. Consecutive windows with the same anchor are one run: a row of (anchor gram, content hash,
document, first window, number of windows) instead of a row per window.

Two windows can only be equal if their runs have the same anchor gram. Runs of equal content hold equal
windows throughout. ``resolve`` sorts runs by anchor and content and settles all of the latter kind;
what shares an anchor only is handed on to be looked at closer.

Rolling hashes only bring rows together: they are polynomials modulo 2^64, for which texts with equal hashes are easy to
write. What is taken as equal has the same 64 bits of a BLAKE2b digest of its units besides.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm.common import mixed, partitions
from brisa.llm.tokens import kept_by_worker

#: Units handled at a time; longer texts are cut into overlapping segments of so many.
SEGMENT = 1 << 20
#: Rows of sorted runs handled at a time.
ROWS = 1 << 18
#: Odd multiplier of the rolling hash (64-bit arithmetic).
BASE = 0x9E3779B97F4A7C15

#: In place of ``x``: this run is known to be repeated.
KNOWN = 0xFFFF

RUN = "g bigint, c bigint, doc bigint, a bigint, n int, x int"


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(SEGMENT + 2, BASE, np.uint64), np.full(SEGMENT + 2, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit units, by sums weighed with powers. Equal ones need not have equal units."""

    def __init__(self, units: np.ndarray):
        self.up, self.down = kept_by_worker("powers", _powers)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def digests(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of each stretch of units."""
    view, width = memoryview(np.ascontiguousarray(units)).cast("B"), units.itemsize
    found = [blake2b(view[s:e], digest_size=8).digest() for s, e in zip((start * width).tolist(), (end * width).tolist())]
    return np.frombuffer(b"".join(found), np.uint64)


def segments(sizes: np.ndarray, length: int):
    """Groups of (text, start, end) with at most SEGMENT units, every window in exactly one of them."""
    group, total = [], 0
    for text, size in enumerate(sizes.tolist()):
        for start in range(0, max(size - length + 1, 0), SEGMENT - length + 1):
            end = min(start + SEGMENT, size)
            if total + end - start > SEGMENT:
                yield group
                group, total = [], 0
            group.append((text, start, end))
            total += end - start
    if group:
        yield group


def runs(raw: np.ndarray, units: np.ndarray, order: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Runs of windows of concatenated stretches: stretch, first window, windows, anchor place, anchor hash and content digest.

    ``raw`` holds the units as they are compared, ``units`` as they are hashed for anchors. ``order`` ranks the units'
    grams by up to 40 bits; with None their hashes do.
    """
    first = Rolling(units)
    total, width = len(units), length - gram + 1
    places = np.arange(total - gram + 1)
    grams = first.of(places, places + gram)
    rank = grams >> np.uint64(24) if order is None else order[: len(places)]
    least = (rank << np.uint64(24)) | places.astype(np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + length <= ends[owner])
    chosen = anchor[valid]
    new = np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(valid) != 1)])
    at = np.flatnonzero(new)
    a, n = valid[at], np.diff(np.append(at, len(valid)))
    p = chosen[at]
    shape = mixed(((p - a) << 20 | n).astype(np.uint64))
    content = digests(raw, a, a + n - 1 + length) ^ shape
    return owner[a], a - starts[owner[a]], n, p - a, grams[p], content


def known_here(g, c, doc, a, rule: str) -> np.ndarray:
    """Which runs the others read with them show to be repeated, whatever other texts hold.

    Of equal runs only the first, with rule "other" the first two, have to meet those of other tasks at their anchor: a
    short pattern that a text repeats, or a text that many documents hold, comes there once a task.
    """
    order = np.lexsort((a, doc, c, g))
    same = (np.diff(g[order]) == 0) & (np.diff(c[order]) == 0)
    start = np.concatenate([[0], np.flatnonzero(~same) + 1])
    size = np.diff(np.append(start, len(order)))
    place = np.arange(len(order)) - np.repeat(start, size)
    out = np.zeros(len(order), bool)
    if rule == "document":
        out[order] = doc[order] > np.repeat(doc[order][start], size)
    else:
        out[order] = place >= (1 if rule == "first" else 2)
    return out


def spread_known(g, c, doc, a, x, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and ``x`` of runs: known ones are marked, and dealt by their place instead of their anchor."""
    if not len(g):
        return g, x
    known = known_here(g, c, doc, a, rule)
    return np.where(known, mixed(doc.astype(np.uint64) + mixed(a.astype(np.uint64))), g), np.where(known, KNOWN, x)


def batch_of(columns: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        values = np.ascontiguousarray(columns[field.name])
        values = values.view(np.int64) if values.dtype == np.uint64 else values
        arrays.append(pa.array(values).cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


RUN_SCHEMA = pa.schema([(n, pa.int64()) for n in ("g", "c", "doc", "a")] + [("n", pa.int32()), ("x", pa.int32())])


def settled(g, c, doc, known, rule: str, forced: bool, carried):
    """Which of the sorted runs hold windows that are repeated, and which must be looked at closer.

    ``carried`` is the first (doc, a) of the first class here if that began earlier. ``forced``
    says that further classes of the anchors here are elsewhere.
    """
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
    class_, group = np.cumsum(new_c) - 1, np.cumsum(new_g) - 1
    first = np.flatnonzero(new_c)
    size = np.diff(np.append(first, len(g)))
    first_doc = doc[first].copy()
    is_first = new_c.copy()
    if carried is not None:
        first_doc[0], is_first[0] = carried[0], False
        size[0] += 1
    if rule == "document":
        repeated = doc > first_doc[class_]
    elif rule == "first":
        repeated = ~is_first
    else:
        repeated = size[class_] > 1
    classes = np.bincount(group[first])
    closer = ((classes[group] > 1) | forced) & (is_first | ~repeated) & ~known
    return repeated | known, closer


def resolve(found: DataFrame, rule: str) -> DataFrame:
    """Runs with ``closer``: false for repeated ones, true for those to be looked at closer; others go.

    A window is repeated if it is also elsewhere (rule "other"), at an earlier place ("first"), or in a document of
    smaller id ("document"). Runs are sorted, so a task holds a bounded number of them at a time,
    however many share an anchor or a content.
    """
    schema = RUN_SCHEMA.append(pa.field("closer", pa.bool_()))
    names = RUN_SCHEMA.names

    def run(batches):
        held, count, carried, mid_group = [], 0, None, False

        def give(rows, forced):
            repeated, closer = settled(rows["g"], rows["c"], rows["doc"], rows["x"] == KNOWN, rule, forced, carried)
            for mark, at in ((False, np.flatnonzero(repeated)), (True, np.flatnonzero(closer))):
                if len(at):
                    columns = {k: rows[k][at] for k in names} | {"closer": np.full(len(at), mark)}
                    yield batch_of(columns, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, doc, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            held.append(dict(g=g, c=c, doc=doc, a=at >> 32, n=at >> 16 & 0xFFFF, x=at & 0xFFFF))
            count += batch.num_rows
            if count < ROWS:
                continue
            rows = {k: np.concatenate([h[k] for h in held]) for k in names}
            g, c = rows["g"], rows["c"]
            new_g = np.flatnonzero(g[1:] != g[:-1]) + 1
            new_c = np.flatnonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1])) + 1
            if len(new_g):
                cut, forced = int(new_g[-1]), mid_group
                # The first anchor may have begun earlier; the others are whole.
                if forced:
                    yield from give({k: v[: new_g[0]] for k, v in rows.items()}, True)
                    carried = None
                    if len(new_g) > 1:
                        yield from give({k: v[new_g[0] : cut] for k, v in rows.items()}, False)
                else:
                    yield from give({k: v[:cut] for k, v in rows.items()}, False)
                carried, mid_group = None, False
            elif len(new_c):
                cut = int(new_c[-1])
                yield from give({k: v[:cut] for k, v in rows.items()}, True)
                carried, mid_group = None, True
            else:
                cut = count - 1
                yield from give({k: v[:cut] for k, v in rows.items()}, True)
                carried, mid_group = carried or (rows["doc"][0], rows["a"][0]), True
            held = [{k: v[cut:] for k, v in rows.items()}]
            count -= cut
        if count:
            rows = {k: np.concatenate([h[k] for h in held]) for k in names}
            new_g = np.flatnonzero(rows["g"][1:] != rows["g"][:-1]) + 1
            cut = int(new_g[0]) if mid_group and len(new_g) else (count if mid_group else 0)
            if cut:
                yield from give({k: v[:cut] for k, v in rows.items()}, True)
                carried = None
            if cut < count:
                yield from give({k: v[cut:] for k, v in rows.items()}, False)

    n = partitions(found.sparkSession)
    # One number for the three that are small: it is these rows that fill the shuffle.
    at = F.shiftleft("a", 32) + F.shiftleft(F.col("n").cast("long"), 16) + F.col("x")
    dealt = found.select("g", "c", "doc", at.alias("at")).repartition(n, "g").sortWithinPartitions("g", "c", "doc", "at")
    return dealt.mapInArrow(run, RUN + ", closer boolean")


def by_document(spans: DataFrame, fields: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """(doc, spans) with all (start, end) of a document; as many as it has windows at most."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("spans"))


def merged(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal ones within a text of so many units."""
    at = np.argsort(start, kind="stable")
    start, end = np.minimum(start[at], size), np.minimum(np.maximum.accumulate(end[at]), size)
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(first) else end
