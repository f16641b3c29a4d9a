"""Aligning the tokens of two tokenizers by the bytes they cover.

A is a byte-level BPE over space + text, B a sentencepiece BPE over the text, which adds that space itself. Bytes where
tokens of both end cut a text's tokens into groups; every A token of a group is linked with every B token of it.

Groups of a text come from an associative composition of fragments. A fragment stands for the tokens that end in a range of bytes:
an open prefix (tokens up to the first common end), closed groups, and an open suffix (tokens after the last common end), or tokens only
if no end is common. Two neighbours compose by closing one group from the left one's suffix and the right one's prefix. Texts of up to
``LONG`` bytes are one fragment. Longer ones are cut every ``CHUNK`` bytes, wherever that is, into rows that Spark deals to tasks;
their fragments are composed in a tree, ``FAN`` neighbours at a time, a shuffle per level.

Tokens of a range are encoded from whole units. A unit begins at a space between two characters that are neither white space nor
U+2581. Neither vocabulary has a token across that place: A's pattern begins a word there, and no piece of B holds U+2581
after anything else, which is checked when the vocabulary is loaded. So units can be encoded, and remembered, one by one. A unit longer than a chunk is not cut.

Every row counts for itself, also rows that repeat an id or have none. Texts that are null, empty, or not spelled by the
tokens of both have no tokens: zeros and an empty hash. Empty tables give no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brisa.llm.common import partitions, stored
from brisa.llm.tokens import encoders, kept_by_worker

#: Bytes of a text that one task aligns, and of the ranges that longer texts are cut into.
LONG, CHUNK = 1 << 15, 1 << 14
#: Neighbouring fragments that one composition takes.
FAN = 16
#: Units that a worker remembers, ids of A that all of them have at most, and characters of units that are encoded in one text.
REMEMBERED, HELD, JOINED = 1 << 18, 1 << 21, 1 << 14
#: Links of a group up to which they are listed one by one, before equal ones are counted.
LISTED = 1 << 12
#: Ranges whose units are encoded together.
TOGETHER = 64
#: Id pairs broadcast at a time.
SLICE = 1 << 21

#: Fixed value: where units are parted.
PARTING = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_SPACED = re.compile(r"\s\s")
#: White space as Python knows it, and U+2581: a space beside one of these parts nothing.
_NO_EDGES = [chr(i) for i in range(0x3001) if chr(i).isspace()] + ["▁"]

_NONE = np.zeros(0, np.int64)


class Fragment(NamedTuple):
    """Tokens that end in a range of bytes. Without a common end all of them are in ``head``.

    ``pairs`` and ``times`` hold the closed groups' links by id pair, (A id << 16 | B id), and how often each is linked.
    """

    closed: bool
    head_a: list[int]
    head_b: list[int]
    tail_a: list[int]
    tail_b: list[int]
    n_groups: int
    groups: bytes
    pairs: np.ndarray
    times: np.ndarray


EMPTY = Fragment(False, [], [], [], [], 0, b"", _NONE, _NONE)


def _links(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs of a group and their numbers, by distinct ids."""
    if len(a) == 1 and len(b) == 1:
        return np.array([a[0] << 16 | b[0]]), np.ones(1, np.int64)
    (x, p), (y, q) = (np.unique(np.array(v, np.int64), return_counts=True) for v in (a, b))
    return (x[:, None] << 16 | y).ravel(), (p[:, None] * q).ravel()


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, times = np.concatenate([_NONE, *pairs]), np.concatenate([_NONE, *times])
    distinct, place = np.unique(pairs, return_inverse=True)
    return distinct, np.bincount(place, times, len(distinct)).astype(np.int64)


def _spread(count: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count in turn."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


class Groups(NamedTuple):
    """Tokens cut at common ends: where groups end among the tokens of A and of B, and the links of each group.

    ``group``, ``pair`` and ``times`` say which id pairs a group links and how often; a pair may be listed several times.
    """

    a_ends: np.ndarray
    b_ends: np.ndarray
    group: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def grouped(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Groups:
    """The groups of token sequences that start together, by the bytes their tokens end at. Tokens after the last common end are in none."""
    at = np.searchsorted(b_ends, a_ends)
    common = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(b_ends) else np.zeros(0, np.int64)
    a_cut, b_cut = common + 1, at[common] + 1
    n_a, n_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    # A row for each A token of a group and B token of it; of groups with many, a row for each pair of distinct ids.
    many = n_a * n_b > LISTED
    of_a = np.repeat(np.arange(len(n_a)), n_a)
    here = np.flatnonzero(~many[of_a])
    width = n_b[of_a[here]]
    left = np.repeat(here, width)
    right = np.repeat((b_cut - n_b)[of_a[here]], width) + _spread(width)
    group, pair = of_a[left], a[left] << 16 | b[right]
    times = np.ones(len(pair), np.int64)
    for g in np.flatnonzero(many).tolist():
        pairs, counts = _links(a[a_cut[g] - n_a[g] : a_cut[g]], b[b_cut[g] - n_b[g] : b_cut[g]])
        group, pair, times = np.append(group, np.full(len(pairs), g)), np.append(pair, pairs), np.append(times, counts)
    return Groups(a_cut, b_cut, group, pair, times)


def _named(a: list[int], b: list[int]) -> bytes:
    return b"%b|%b" % (b",".join([b"%d" % i for i in a]), b",".join([b"%d" % i for i in b]))


def _names(a: list[int], b: list[int], found: Groups) -> list[bytes]:
    """The text of every group."""
    number = kept_by_worker("numbers as text", lambda: [b"%d" % i for i in range(1 << 16)])
    a_ends, b_ends = found.a_ends.tolist(), found.b_ends.tolist()
    n_a, n_b = np.diff(found.a_ends, prepend=0), np.diff(found.b_ends, prepend=0)
    # Most groups have a token of each, which is then their last.
    out = [b"%b|%b" % (number[a[i - 1]], number[b[k - 1]]) for i, k in zip(a_ends, b_ends)]
    for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
        x, y = a[a_ends[g] - n_a[g] : a_ends[g]], b[b_ends[g] - n_b[g] : b_ends[g]]
        out[g] = b"%b|%b" % (b",".join([number[i] for i in x]), b",".join([number[i] for i in y]))
    return out


def fragment(a: list[int], a_ends: np.ndarray, b: list[int], b_ends: np.ndarray) -> Fragment:
    """The fragment of tokens in order, with the bytes they end at."""
    a, b = list(a), list(b)
    found = grouped(np.array(a, np.int64), a_ends, np.array(b, np.int64), b_ends)
    if not len(found.a_ends):
        return Fragment(False, a, b, [], [], 0, b"", _NONE, _NONE)
    # The first group may have begun before.
    closed = found.group > 0
    named = b";".join(_names(a, b, found)[1:])
    ends = found.a_ends.tolist(), found.b_ends.tolist()
    return Fragment(
        True, a[: ends[0][0]], b[: ends[1][0]], a[ends[0][-1] :], b[ends[1][-1] :], len(ends[0]) - 1, named,
        *_summed([found.pair[closed]], [found.times[closed]]),
    )


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with ``EMPTY`` as its neutral element."""
    if not x.closed:
        return y._replace(head_a=x.head_a + y.head_a, head_b=x.head_b + y.head_b)
    if not y.closed:
        return x._replace(tail_a=x.tail_a + y.head_a, tail_b=x.tail_b + y.head_b)
    a, b = x.tail_a + y.head_a, x.tail_b + y.head_b
    pairs, times = _links(a, b)
    groups = b";".join(g for g in (x.groups, _named(a, b), y.groups) if g)
    return Fragment(
        True, x.head_a, x.head_b, y.tail_a, y.tail_b, x.n_groups + 1 + y.n_groups, groups,
        *_summed([x.pairs, pairs, y.pairs], [x.times, times, y.times]),
    )


def composed(fragments: list[Fragment]) -> Fragment:
    """All of a list by halves, so that each is copied as often as the tree is deep."""
    while len(fragments) > 1:
        fragments = [compose(*fragments[i : i + 2]) if i + 1 < len(fragments) else fragments[i] for i in range(0, len(fragments), 2)]
    return fragments[0] if fragments else EMPTY


class Ragged:
    """Lists of numbers in one array; more are added at the end."""

    def __init__(self, kind=np.uint32):
        self.flat, self.sizes, self.starts = np.zeros(0, kind), np.zeros(0, np.int32), _NONE

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some lists one after the other, and how many each has."""
        sizes = self.sizes[which].astype(np.int64)
        return self.flat[np.repeat(self.starts[which], sizes) + _spread(sizes)].astype(np.int64), sizes


class Tokenizers:
    """Both tokenizers, and the units they have met, by number: ids of A and B, groups and their text, id pairs linked and how often."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        ranks = a_path.removesuffix("json") + "tiktoken"
        self.plain, self.any = encoders(ranks)
        self.a_sizes = vocabulary_sizes(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if x else p.replace("▁", " ").encode() for p, x in zip(pieces, byte)]
        self.b_sizes = np.array([len(p) for p in self.b_bytes])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.spelled, self.n_groups = np.zeros(0, bool), _NONE
        self.a_ids, self.b_ids, self.pairs, self.times = Ragged(), Ragged(), Ragged(), Ragged(np.int64)

    def units(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        # In most texts every space is a place to part.
        odd = text[0] == " " or text[-1] == " " or any(c + " " in text or " " + c in text for c in _NO_EDGES)
        return PARTING.split(text) if odd else text.split(" ")

    def _encode(self, text: str, b: list[int]) -> tuple[list[int], list[int]] | None:
        """Ids of space + text, or None if those of B do not spell it."""
        spaced = " " + text
        if b"".join([self.b_bytes[i] for i in b]) != spaced.encode():
            return None
        return (self.any if _SPACED.search(spaced) else self.plain)(spaced), b

    def _add(self, units: list[str]) -> None:
        """Encode units that are new, many in one text: a space between two of them parts them."""
        joined = [u for u in units if not self.whole and u.strip() == u and "▁" not in u and u]
        alone = set(units).difference(joined) if len(joined) < len(units) else set()
        parts, size = [[]], 0
        for u in joined:
            if size > JOINED:
                parts.append([])
                size = 0
            parts[-1].append(u)
            size += len(u)
        parts = [p for p in parts if p] + [[u] for u in units if u in alone]
        found = []
        for part, b in zip(parts, self.b.encode([" ".join(p) for p in parts])):
            tokens = self._encode(" ".join(part), b)
            if tokens is None and len(part) > 1:
                found += [([u], self._encode(u, x)) for u, x in zip(part, self.b.encode(part))]
            else:
                found.append((part, tokens))
        order = [u for part, _ in found for u in part]
        spelled = np.array([t is not None for part, t in found for _ in part], bool)
        sizes = np.array([len(u.encode()) + 1 for u in order], np.int64) * spelled
        a_flat, b_flat = (list(chain.from_iterable(t[i] for _, t in found if t is not None)) for i in range(2))
        a, b = np.array(a_flat, np.int64), np.array(b_flat, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        groups = grouped(a, a_ends, b, b_ends)
        names = _names(a_flat, b_flat, groups)
        # Units end at common ends, so every token and group lies in one.
        ends = np.cumsum(sizes)
        counts = lambda at: np.diff(np.searchsorted(at, ends, "right"), prepend=0)
        n_groups = counts(a_ends[groups.a_ends - 1])
        unit_of_group = np.repeat(np.arange(len(order)), n_groups)
        unit = unit_of_group[groups.group]
        by_unit = np.argsort(unit, kind="stable")
        n_pairs = np.bincount(unit, minlength=len(order))
        self.a_ids.add(a, counts(a_ends))
        self.b_ids.add(b, counts(b_ends))
        self.pairs.add(groups.pair[by_unit], n_pairs)
        self.times.add(groups.times[by_unit], n_pairs)
        self.spelled, self.n_groups = np.concatenate([self.spelled, spelled]), np.concatenate([self.n_groups, n_groups])
        at = np.cumsum(n_groups).tolist()
        self.texts += [b";".join(names[i:j]) for i, j in zip([0, *at], at)]
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers, which hold until the next call."""
        if len(self.known) > REMEMBERED or len(self.a_ids.flat) > HELD:
            self.forget()
        new = list(set(units).difference(self.known))
        if new:
            self._add(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))


def vocabulary_sizes(path: str) -> np.ndarray:
    """Bytes of every token of a rank file."""
    import base64

    with open(path, "rb") as lines:
        ranks = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks) + 1, np.int64)
    sizes[list(ranks)] = list(ranks.values())
    return sizes


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    return kept_by_worker(f"tokenizers {paths}", lambda: Tokenizers(*paths))


DIGEST = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<bigint>"
_DIGEST = pa.schema(
    [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
)
NO_TOKENS = (0, 0, 0, 0, "", np.zeros(0, np.int32), _NONE)


def _digest(n_a: int, n_b: int, n_groups: int, groups: bytes, pairs: np.ndarray, times: np.ndarray) -> tuple:
    """A pair takes 32 bits, read as a signed number."""
    return n_a, n_b, n_groups, int(times.sum()), hashlib.sha256(groups).hexdigest(), pairs.astype(np.uint32).view(np.int32), times


def digests_of(texts: list[str], both: Tokenizers) -> list[tuple]:
    """What each of some texts has: its units' groups in order, and their links, all texts at once."""
    units = [both.units(t) if t else [] for t in texts]
    code = both.numbers(list(chain.from_iterable(units)))
    n_units = np.array([len(u) for u in units], np.int64)
    owner = np.repeat(np.arange(len(texts)), n_units)
    spelled = n_units > 0
    spelled[owner[~both.spelled[code]]] = False
    # The distinct units of each text, and the links of each.
    known = max(len(both.known), 1)
    taken, often = np.unique(owner * known + code, return_counts=True)
    pairs, width = both.pairs.of(taken % known)
    times, _ = both.times.of(taken % known)
    key = np.repeat(taken // known, width) << 32 | pairs
    distinct, place = np.unique(key, return_inverse=True)
    number = np.bincount(place, np.repeat(often, width) * times, len(distinct)).astype(np.int64)
    bounds = np.searchsorted(distinct, np.arange(len(texts) + 1) << 32).tolist()
    low = (distinct & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    sums = lambda per_unit: np.bincount(owner, per_unit[code], len(texts)).astype(np.int64).tolist()
    n_a, n_b, n_groups = sums(both.a_ids.sizes), sums(both.b_ids.sizes), sums(both.n_groups)
    ends, listed = np.cumsum(n_units).tolist(), code.tolist()
    out = []
    for i in range(len(texts)):
        if not spelled[i]:
            out.append(NO_TOKENS)
            continue
        groups = b";".join([both.texts[c] for c in listed[ends[i] - len(units[i]) : ends[i]]])
        some = slice(bounds[i], bounds[i + 1])
        links = int(number[some].sum())
        out.append((n_a[i], n_b[i], n_groups[i], links, hashlib.sha256(groups).hexdigest(), low[some], number[some]))
    return out


def _rows(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_DIGEST)]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_DIGEST.names])


def _short(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches):
        both = tokenizers(paths)
        for batch in batches:
            yield _rows(batch, digests_of(batch.column(1).to_pylist(), both))

    return docs.mapInArrow(run, "doc_id bigint, " + DIGEST)


def borders(sizes: list[int], chunk: int) -> list[int]:
    """Ends of byte ranges of a text, given its units' sizes: every ``chunk`` bytes; within a longer unit only at its end."""
    ends, out, last = np.cumsum(sizes), [], 0
    for end, size in zip(ends.tolist(), sizes):
        if size > chunk:
            if end - size > last:
                out.append(end - size)
            out.append(end)
            last = end
        else:
            while last + chunk < end:
                last += chunk
                out.append(last)
    if not out or out[-1] < ends[-1]:
        out.append(int(ends[-1]))
    return out


CHUNKS = "key bigint, doc_id bigint, part int, begin bigint, low bigint, high bigint, text string"


def _chunks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of byte ranges (low, high] with the text of the whole units around them, which begins at ``begin``."""

    def run(batches):
        both = tokenizers(paths)
        for batch in batches:
            key, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                units = both.units(text.as_py())
                # With the space before it, as A reads it.
                sizes = [len(u.encode()) + 1 for u in units]
                ends = np.cumsum(sizes)
                low, rows = 0, []
                for part, high in enumerate(borders(sizes, CHUNK)):
                    first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
                    rows.append((key[i], ids[i], part, int(ends[first] - sizes[first]), low, high, " ".join(units[first : last + 1])))
                    low = high
                yield pa.RecordBatch.from_pylist([dict(zip(CHUNK_SCHEMA.names, r)) for r in rows], CHUNK_SCHEMA)

    return docs.mapInArrow(run, CHUNKS)


CHUNK_SCHEMA = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32())]
    + [(n, pa.int64()) for n in ("begin", "low", "high")] + [("text", pa.string())]
)


def ranged(code: np.ndarray, begin: int, low: int, high: int, both: Tokenizers) -> tuple[int, int, Fragment] | None:
    """Tokens of A and B that end in (low, high], and their fragment, from the numbers of whole units, the first of which begins at ``begin``."""
    if not both.spelled[code].all():
        return None
    a, b = both.a_ids.of(code)[0], both.b_ids.of(code)[0]
    a_ends, b_ends = begin + np.cumsum(both.a_sizes[a]), begin + np.cumsum(both.b_sizes[b])
    (i, j), (k, m) = (np.searchsorted(e, [low, high], "right").tolist() for e in (a_ends, b_ends))
    return j - i, m - k, fragment(a[i:j].tolist(), a_ends[i:j], b[k:m].tolist(), b_ends[k:m])


FRAGMENT = (
    "spelled boolean, n_a bigint, n_b bigint, closed boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, "
    "n_groups bigint, groups binary, pairs array<bigint>, times array<bigint>"
)
_FRAGMENT = pa.schema(
    [("spelled", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("closed", pa.bool_())]
    + [(n, pa.list_(pa.int32())) for n in ("head_a", "head_b", "tail_a", "tail_b")]
    + [("n_groups", pa.int64()), ("groups", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def _row(found: tuple[int, int, Fragment] | None) -> tuple:
    return (False, 0, 0, *EMPTY) if found is None else (True, found[0], found[1], *found[2])


def _fragments(chunks: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(key, doc_id, part, fragment fields) of each byte range."""

    def run(batches):
        both = tokenizers(paths)
        for batch in (whole.slice(i, TOGETHER) for whole in batches for i in range(0, whole.num_rows, TOGETHER)):
            units = [both.units(t) for t in batch.column("text").to_pylist()]
            code = np.split(both.numbers(list(chain.from_iterable(units))), np.cumsum([len(u) for u in units])[:-1])
            places = zip(*(batch.column(n).to_pylist() for n in ("begin", "low", "high")))
            rows = [_row(ranged(c, *place, both)) for c, place in zip(code, places)]
            columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_FRAGMENT)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "doc_id", "part")), *columns], ["key", "doc_id", "part", *_FRAGMENT.names])

    dealt = chunks.repartition(partitions(chunks.sparkSession), "key", "part")
    return dealt.mapInArrow(run, f"key bigint, doc_id bigint, part int, {FRAGMENT}")


def _as_fragment(f: dict) -> Fragment:
    return Fragment(*(f[n] for n in Fragment._fields[:7]), *(np.array(f[n], np.int64) for n in ("pairs", "times")))


def _whole_of(held: list[dict]) -> tuple[int, int, Fragment] | None:
    """Neighbouring fragments, in any order, as one; None if the tokens of one of them do not spell it."""
    if not all(f["spelled"] for f in held):
        return None
    held = sorted(held, key=lambda f: f["part"])
    return sum(f["n_a"] for f in held), sum(f["n_b"] for f in held), composed([_as_fragment(f) for f in held])


def _composed(parts: DataFrame, last: bool = False) -> DataFrame:
    """One level of the tree: ``FAN`` neighbours become one. The last level gives the digests of whole texts."""
    start = Fragment(True, [], [], [], [], 0, b"", _NONE, _NONE)

    def fragments(batches):
        for batch in batches:
            rows = [_row(_whole_of(held.as_py())) for held in batch.column(2)]
            columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_FRAGMENT)]
            part = pa.array(batch.column(1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), part, *columns], ["key", "doc_id", "part", *_FRAGMENT.names])

    def whole(batches):
        for batch in batches:
            rows = []
            for held in batch.column(2):
                found = _whole_of(held.as_py())
                if found is None or not found[2].closed:
                    rows.append(NO_TOKENS)
                    continue
                # The first group lies in the head.
                n_a, n_b, own = found[0], found[1], compose(start, found[2])
                rows.append(_digest(n_a, n_b, own.n_groups, own.groups, own.pairs, own.times))
            yield _rows(batch.select(["doc_id"]), rows)

    above = F.floor(F.col("part") / FAN).cast("int").alias("above")
    grouped = parts.groupBy("key", above).agg(F.collect_list(F.struct("part", *_FRAGMENT.names)).alias("held"), F.first("doc_id").alias("doc_id"))
    if last:
        return grouped.mapInArrow(whole, "doc_id bigint, " + DIGEST)
    return grouped.mapInArrow(fragments, f"key bigint, doc_id bigint, part int, {FRAGMENT}")


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every text; ``pairs`` are distinct."""
    paths = (a_path, b_path)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    short = _short(plain.where(size <= LONG), paths)
    long = plain.where(size > LONG).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    chunks = stored(_chunks(long, paths), "chunks")
    last = chunks.agg(F.max("part")).first()[0]
    if last is None:
        return short
    parts = _fragments(chunks, paths)
    while last >= FAN:
        parts, last = _composed(parts), last // FAN
    return short.unionByName(_composed(parts, last=True))


def counted(found: DataFrame) -> DataFrame:
    """(pair, count, best): in how many texts each id pair is linked, and whether that is the most of its A id."""
    a = F.shiftrightunsigned("pair", 16).alias("a")
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    known = counts.select("pair", "count", a).join(most, "a")
    return stored(known.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    An id pair's count is the number of documents that hold it linked. ``count_sum`` adds the counts of all links,
    ``n_best`` is the number of links whose count no other pair of their A id exceeds. The counted pairs are joined to the
    documents' in slices of about ``SLICE`` pairs, each small enough to broadcast, so documents are not shuffled by pair.
    """
    found = digests(docs, a_path, b_path)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "digests")
    counts = counted(found)
    slices = max(1, -(-counts.count() // SLICE))
    slice_ = F.pmod(F.xxhash64("pair"), F.lit(slices))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.times")
    parts = []
    for i in range(slices):
        some = links.where(slice_ == i).join(F.broadcast(counts.where(slice_ == i)), "pair")
        total = some.groupBy("row").agg(
            F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
        )
        parts.append(total)
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256"
    )
