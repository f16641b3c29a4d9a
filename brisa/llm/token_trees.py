"""Token counts that follow edits without encoding whole texts again.

A text is cut into leaves at single spaces between other characters. The vocabulary's pattern always starts a pre-token
at such a space, whatever surrounds it, and merges do not cross pre-tokens; so leaves are encoded one by one and
their counts add up. A binary tree over the leaves holds the sums of characters and tokens of every subtree, as an
array in which node i has the children 2i and 2i + 1.

An edit descends the tree by characters to the leaves it touches, takes in the leaves whose cut it comes near
(boundary context), encodes that stretch anew and updates the sums on the way up. The stretch becomes the first of
these leaves and the others empty; a tree whose leaves have grown is built anew from its leaves' counts.

A null text counts as empty and has one empty leaf. Edits are in code points of the old text, in any order; their places
are moved into the text, and an edit that overlaps one to its right sees that one's result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.tokens import encoders

#: Characters of a leaf at least, where there is a place to cut.
LEAF = 256
#: A cut stays if the characters next to its space stay.
CONTEXT = 2

SUMS = T.ArrayType(T.IntegerType())
TREE = T.StructType([T.StructField("chars", SUMS), T.StructField("tokens", SUMS)])
EDITS = "array<struct<start:int,removed:int,inserted:string>>"
EDITED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("tree", TREE),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("encoded_chars", T.LongType()),
    ]
)


def cuts(text: str) -> list[int]:
    """Places at which leaves begin, and the end."""
    places, size, at = [0], len(text), LEAF
    while at < size - 1:
        at = text.find(" ", at)
        if at < 0 or at >= size - 1:
            break
        if at - places[-1] >= LEAF and not text[at - 1].isspace() and not text[at + 1].isspace():
            places.append(at)
            at += LEAF
        else:
            at += 1
    return [*places, size]


def count(text: str, path: str) -> int:
    plain, whole = encoders(path)
    return len(whole(text)) if text else 0


def sums(leaves: list[int]) -> list[int]:
    """The tree over leaves as an array; node 1 is the root, place 0 is unused."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    level = np.zeros(width, np.int64)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(axis=1)
        levels.append(level)
    return [0, *(int(x) for level in reversed(levels) for x in level)]


def build(text: str, path: str) -> tuple[list[int], list[int]]:
    """Trees of characters and of tokens."""
    places = cuts(text)
    leaves = [text[a:b] for a, b in zip(places, places[1:])]
    return sums([len(x) for x in leaves]), sums([count(x, path) for x in leaves])


def find(chars: list[int], place: int) -> tuple[int, int]:
    """Leaf node that holds a character, and where that leaf begins; the last one for the end."""
    node, begin, width = 1, 0, len(chars) // 2
    place = min(place, chars[1] - 1)
    while node < width:
        node *= 2
        if place - begin >= chars[node]:
            begin += chars[node]
            node += 1
    return node, begin


def put(tree: list[int], node: int, value: int) -> None:
    """Set a leaf and the sums above it."""
    change = value - tree[node]
    while change and node:
        tree[node] += change
        node //= 2


def edit(text: str, chars: list[int], tokens: list[int], start: int, removed: int, inserted: str, path: str):
    """The edited text and the number of characters encoded; the trees change in place."""
    size = len(text)
    start = min(max(start, 0), size)
    end = min(start + max(removed, 0), size)
    text = text[:start] + inserted + text[end:]
    if not size:
        put(chars, len(chars) // 2, len(text))
        put(tokens, len(chars) // 2, count(text, path))
        return text, len(text)
    first, begin = find(chars, start)
    if start - begin < CONTEXT and begin:
        first, begin = find(chars, begin - 1)
    last, last_begin = find(chars, end)
    if last_begin + chars[last] - end < CONTEXT and last_begin + chars[last] < size:
        last, last_begin = find(chars, last_begin + chars[last])
    finish = last_begin + chars[last] + len(text) - size
    stretch = text[begin:finish]
    for node in range(first + 1, last + 1):
        put(chars, node, 0)
        put(tokens, node, 0)
    put(chars, first, len(stretch))
    put(tokens, first, count(stretch, path))
    return text, len(stretch)


def tree(text: Column, path: str) -> Column:
    """Trees of a text: struct of arrays ``chars`` and ``tokens``; the second entry of each is the total."""

    @F.arrow_udf(TREE)
    def make(column: pa.Array) -> pa.Array:
        built = [build(t or "", path) for t in column.to_pylist()]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array([b[i] for b in built], kind) for i in range(2)], ["chars", "tokens"])

    return make(F.coalesce(text, F.lit("")))


def edited(text: Column, trees: Column, edits: Column, path: str) -> Column:
    """Text, trees, number of tokens and number of encoded characters after edits (start, removed, inserted)."""

    @F.arrow_udf(EDITED)
    def apply(column: pa.Array, grown: pa.Array, changes: pa.Array) -> pa.Array:
        rows = []
        for text, sums_, todo in zip(column.to_pylist(), grown.to_pylist(), changes.to_pylist()):
            chars, tokens, encoded = list(sums_["chars"]), list(sums_["tokens"]), 0
            # From the right, so places to the left keep their meaning.
            for e in sorted(todo or [], key=lambda e: (e["start"], e["removed"]), reverse=True):
                text, some = edit(text, chars, tokens, e["start"], e["removed"], e["inserted"] or "", path)
                encoded += some
            rows.append((text, chars, tokens, tokens[1], encoded))
        kind = pa.list_(pa.int32())
        sums_ = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i in (1, 2)], ["chars", "tokens"])
        parts = [pa.array([r[0] for r in rows], pa.string()), sums_]
        parts += [pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4)]
        return pa.StructArray.from_arrays(parts, [f.name for f in EDITED])

    return apply(F.coalesce(text, F.lit("")), trees, edits.cast(EDITS))


def counts_after_edits(docs: DataFrame, edits: Column, path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars) of every document and its edits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    grown = docs.select("doc_id", text.alias("text"), edits.alias("edits")).withColumn("tree", tree(F.col("text"), path))
    after = grown.withColumn("after", edited(F.col("text"), F.col("tree"), F.col("edits"), path))
    return after.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.col("tree.tokens")[1].cast("long").alias("n_tokens"),
        F.length("after.text").cast("long").alias("edited_chars"),
        F.col("after.n_tokens").alias("edited_tokens"),
        F.sha2("after.text", 256).alias("edited_sha256"),
        F.col("after.encoded_chars").alias("encoded_chars"),
    )
