"""Toxicity by a support vector machine over a gapped-subsequence string kernel.

Two strings are alike by the subsequences of three and four characters they share, each weighed down by
the characters it skips, so insults with inserted, left-out or changed characters stay near the plain
ones. Landmark words of the labelled texts span the kernel (Nyström): the machine is linear in the
landmarks' whitened similarities. As the kernel is a sum over subsequences, the trained machine is one
weight per (hashed) subsequence, and a word's score a sum of such weights.

Labels belong to texts, not to words, so training picks the words that witness a toxic text and trains
in turns. A text scores as its worst word; a logistic curve fitted on the training texts gives 0 to 1.

Words are runs of non-white-space in lower case without punctuation; three or more single characters
in a row also count as one word, so spelled-out insults are seen. Long words are read in overlapping parts,
whole texts always. A null text counts as empty; a text without words scores as the mildest word would.
Without labelled texts of both kinds every score is 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brisa.llm.common import texts

#: Training texts of each kind at most; this bounds what the driver holds.
TRAINING_TEXTS = 1500
LANDMARKS = 160
#: Words of clean texts that training sets against the toxic ones.
CLEAN_WORDS = 20_000
ROUNDS = 4
#: Log odds from which a word (or how it begins) tells a toxic text at first.
TELLING = 2.9
DECAY = 0.8
SLOTS = 1 << 16
#: Places of the characters of a subsequence after its first one.
SHAPES = [(1 + a, 2 + a + b) for a in range(3) for b in range(3)] + [
    (1 + a, 2 + a + b, 3 + a + b + c) for a in range(2) for b in range(2) for c in range(2)
]
#: Characters read at a time of a long word, and by how many the parts overlap.
PART, OVERLAP = 30, 12
#: Words and texts handled at a time, which bounds the memory.
WORDS_AT_A_TIME, TEXTS_AT_A_TIME = 20_000, 200
#: Score of a text without words.
MILDEST = -2.0


def words_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch, and for each place its word and its text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    coded = pc.dictionary_encode(lists.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.replace_substring_regex(coded.dictionary, r"[^\pL\pN]+", "")
    words = plain.to_pylist()
    single = (pc.utf8_length(plain).to_numpy(zero_copy_only=False) == 1)[codes] if len(codes) else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]])) | np.concatenate([[False], np.diff(owner) != 0, [False]])) if len(codes) else []
    more_codes, more_owners = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= 3 and single[a]:
            more_codes.append(len(words))
            more_owners.append(owner[a])
            words.append("".join(words[c] for c in codes[a:b]))
    return words, np.append(codes, more_codes).astype(np.int64), np.append(owner, more_owners).astype(np.int64)


def parts_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words with an end mark on both sides, cut into parts: characters, lengths, word of each."""
    whole = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(1, -(-(lengths - OVERLAP) // (PART - OVERLAP)))
    word = np.repeat(np.arange(len(words)), count)
    step = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(PART, lengths[word] - step * (PART - OVERLAP))
    at = (starts[word] + step * (PART - OVERLAP))[:, None] + np.arange(PART)
    inside = np.arange(PART) < size[:, None]
    return np.where(inside, whole[np.minimum(at, len(whole) - 1)], 0), size, word


def subsequences(letters: np.ndarray):
    """For each shape: hashed subsequences, their weights."""
    for number, shape in enumerate(SHAPES):
        n = letters.shape[1] - shape[-1]
        if n <= 0:
            continue
        h = letters[:, :n] * np.uint32(0x9E3779B1)
        for place, factor in zip(shape, (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)):
            h = h + letters[:, place : place + n] * np.uint32(factor)
        # Subsequences are the same whatever they skip; those of three and four characters differ.
        h = (h + np.uint32(len(shape))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x297A2D39)) >> np.uint32(16), letters[:, shape[-1] :] != 0, DECAY ** (shape[-1] - len(shape))


def _by_length(letters: np.ndarray, size: np.ndarray):
    for low, high in ((0, 8), (8, 12), (12, 18), (18, PART)):
        at = np.flatnonzero((size > low) & (size <= high))
        for i in range(0, len(at), 20_000):
            yield at[i : i + 20_000], letters[at[i : i + 20_000], :high]


def scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's subsequences; of a long word, its worst part's."""
    many = [_scores(words[i : i + WORDS_AT_A_TIME], weights) for i in range(0, len(words), WORDS_AT_A_TIME)]
    return np.concatenate([np.zeros(0), *many])


def _scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    letters, size, word = parts_of(words)
    part = np.zeros(len(word))
    for at, rows in _by_length(letters, size):
        for slot, there, weight in subsequences(rows):
            part[at] += (weights[slot] * there).sum(axis=1) * weight
    out = np.full(len(words), -np.inf)
    np.maximum.at(out, word, part)
    return out


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each word with each landmark."""
    spread = np.zeros((SLOTS, len(landmarks)), np.float32)
    letters, size, word = parts_of(landmarks)
    for slot, there, weight in subsequences(letters):
        rows, columns = np.nonzero(there)
        np.add.at(spread, (slot[rows, columns], word[rows]), np.float32(weight))
    letters, size, word = parts_of(words)
    used = np.flatnonzero(spread.any(axis=1))
    place = np.zeros(SLOTS, np.int64)
    place[used] = np.arange(1, len(used) + 1)
    spread = np.vstack([np.zeros((1, len(landmarks)), np.float32), spread[used]])
    out = np.zeros((len(words), len(landmarks)))
    for at, rows in _by_length(letters, size):
        for i in range(0, len(at), 1000):
            some, part = at[i : i + 1000], np.zeros((len(at[i : i + 1000]), len(landmarks)), np.float32)
            for slot, there, weight in subsequences(rows[i : i + 1000]):
                row, column = np.nonzero(place[slot] * there)
                hits = np.zeros_like(part)
                for c in np.unique(column):
                    r = row[column == c]
                    hits[r] += spread[place[slot[r, c]]]
                part += hits * np.float32(weight)
            np.add.at(out, word[some], part)
    return out


def _machine(features: np.ndarray, side: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last coefficient is the offset."""
    x = np.column_stack([features, np.ones(len(features))])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6

    def loss(w):
        return w @ keep @ w + cost @ np.maximum(0, 1 - side * (x @ w)) ** 2

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(60):
        active = side * (x @ w) < 1
        xa = x[active] * cost[active, None]
        step = np.linalg.solve(keep + xa.T @ x[active], xa.T @ side[active]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * now:
            break
    return w


@dataclass
class Model:
    """Weights of subsequences, offset, and slope and shift of the logistic curve."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float
    landmarks: list[str]

    def curve(self, worst: np.ndarray) -> np.ndarray:
        if not len(self.landmarks):
            return np.zeros(np.shape(worst))
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, slightly regularised, classes weighing alike."""
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    a = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (cost * (p - y)) + 0.05 * w
        hess = (a * (cost * p * (1 - p) + 1e-9)[:, None]).T @ a + 0.05 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return max(float(w[0]), 1e-3), float(w[1])


def _landmarks(words: list[str], gain: np.ndarray, number: int) -> list[str]:
    """Words of highest gain that are not nearly one of those chosen before."""
    order = np.lexsort((words, -gain))[: 8 * number]
    pool = [words[i] for i in order]
    k = similarities(pool, pool)
    own = np.sqrt(np.diag(k))
    k = k / (own[:, None] * own[None, :])
    chosen: list[int] = []
    for i in range(len(pool)):
        if len(chosen) < number and (not chosen or k[i, chosen].max() < 0.85):
            chosen.append(i)
    return [pool[i] for i in chosen]


def _first_copies(text: np.ndarray, word: np.ndarray, words: list[str], count: int) -> np.ndarray:
    """Which texts are no copies of earlier ones, by the least hashes of their words: words of copies tell nothing."""
    kept, seen = np.ones(count, bool), set()
    hashes = [np.array([zlib.crc32(w.encode(), salt) for w in words], np.int64) for salt in (1, 2)]
    bounds = np.searchsorted(text, np.arange(count + 1))
    for i in range(count):
        own = word[bounds[i] : bounds[i + 1]]
        marks = {(salt, *np.sort(h[own])[:3].tolist()) for salt, h in enumerate(hashes)} if len(own) else set()
        kept[i] = not marks & seen
        seen |= marks
    return kept


def _inserted(words: list[str], most: int = 3000) -> list[str]:
    """The words with one more character inside, so that training sees such insults too."""
    bent = [
        w[:k] + "x10aeiosz"[zlib.crc32(f"{w}{k}".encode()) % 9] + w[k:] for w in words if 4 <= len(w) <= 14 for k in range(1, len(w))
    ]
    return sorted(bent, key=lambda w: zlib.crc32(w.encode()))[:most]


def train(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """Fit on labelled texts (text, 0 or 1)."""
    label = np.array([y for _, y in rows], np.int64)
    empty = Model(np.zeros(SLOTS, np.float32), 0.0, 0.0, -np.inf, [])
    if not (0 < label.sum() < len(label)):
        return empty
    number: dict[str, int] = {}
    found = []
    for start in range(0, len(rows), TEXTS_AT_A_TIME):
        some = pa.array([t or "" for t, _ in rows[start : start + TEXTS_AT_A_TIME]], pa.large_string())
        words, codes, owner = words_of(some)
        place = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(codes):
            found.append(np.unique((owner + start) << 32 | place[codes]))
    words = list(number)
    pairs = np.concatenate([np.zeros(0, np.int64), *found])
    text, word = pairs >> 32, pairs & 0xFFFFFFFF
    long_enough = np.array([len(w) > 2 for w in words], bool)
    text, word = (v[long_enough[word]] for v in (text, word)) if len(words) else (text, word)
    if not len(text):
        return empty
    kept = _first_copies(text, word, words, len(label))
    text, word = text[kept[text]], word[kept[text]]
    toxic = label[text] == 1
    n_toxic, n_clean = label[kept].sum(), (1 - label[kept]).sum()
    seen_toxic = np.bincount(word[toxic], minlength=len(words))
    seen_clean = np.bincount(word[~toxic], minlength=len(words))

    # First guess: how much more often toxic texts hold a word's beginnings and the word itself.
    # Counts of toxic texts less their spread: a few by chance do not tell.
    gain = np.full(len(words), -9.0)
    for size in (4, 5, 6, 99):
        heads: dict[str, int] = {}
        head = np.array([heads.setdefault(w[:size], len(heads)) for w in words], np.int64)
        held = np.unique(text << 32 | head[word])
        is_toxic = label[held >> 32] == 1
        a = np.bincount((held & 0xFFFFFFFF)[is_toxic], minlength=len(heads))
        b = np.bincount((held & 0xFFFFFFFF)[~is_toxic], minlength=len(heads))
        odds = np.log((a - np.sqrt(a) + 0.1) / n_toxic) - np.log((b + 0.6) / n_clean)
        gain = np.maximum(gain, np.where(a > 1, odds, -9.0)[head])
    # The last are the words themselves: these alone tell a toxic text.
    sure = np.flatnonzero(odds[head] > TELLING)
    gain[seen_toxic == 0] = -9.0

    # A witness is a word that clean texts hold seldom.
    rare = seen_toxic / n_toxic > 5 * seen_clean / n_clean
    clean_only = np.flatnonzero((seen_clean > 0) & (seen_toxic <= seen_clean))
    picked = np.array([zlib.crc32(words[i].encode()) for i in clean_only], np.int64)
    common = clean_only[np.argsort(-seen_clean[clean_only], kind="stable")[: CLEAN_WORDS // 4]]
    sample = clean_only[np.argsort(picked, kind="stable")[:CLEAN_WORDS]]
    against = np.unique(np.concatenate([common, sample]))
    score = gain
    model_weights, offset = np.zeros(SLOTS), 0.0
    chosen: list[str] = []
    for turn in range(ROUNDS):
        # The witness of a toxic text is its highest word.
        at = np.flatnonzero(toxic & rare[word])
        ranked = at[np.lexsort((-seen_toxic[word[at]], -score[word[at]], text[at]))]
        _, first = np.unique(text[ranked], return_index=True)
        witness = word[ranked[first]]
        strong = score[witness] > (TELLING if turn == 0 else 0.5)
        if strong.any():
            witness = witness[strong]
        positive, weight = np.unique(np.concatenate([witness, sure]), return_counts=True)
        against_now = np.setdiff1d(against, positive)
        if turn < 2:
            half = landmarks * 3 // 4
            value = np.bincount(positive, weight, len(words)) + np.clip(score, 0, None) * 1e-3
            chosen = _landmarks([words[i] for i in positive], value[positive], half)
            chosen += [w for w in _landmarks([words[i] for i in common], seen_clean[common].astype(float), landmarks - len(chosen)) if w not in chosen]
            inner = similarities(chosen, chosen)
            values, vectors = np.linalg.eigh(inner)
            keep = values > 1e-6 * values.max()
            white = vectors[:, keep] / np.sqrt(values[keep])
        bent = _inserted([words[i] for i in positive])
        side = np.repeat([1.0, 1.0, -1.0], [len(positive), len(bent), len(against_now)])
        parts = (np.sqrt(weight), np.full(len(bent), 0.5), np.full(len(against_now), 1.0))
        cost = 2000 * np.concatenate([x / max(1.0, x.sum()) for x in parts])
        features = similarities([words[i] for i in positive] + bent + [words[i] for i in against_now], chosen) @ white
        w = _machine(features, side, cost)
        spread = white @ w[:-1]
        model_weights, offset = np.zeros(SLOTS), float(w[-1])
        letters, size, owner_ = parts_of(chosen)
        for slot, there, weight_ in subsequences(letters):
            r, c = np.nonzero(there)
            np.add.at(model_weights, slot[r, c], spread[owner_[r]] * weight_)
        score = scores(words, model_weights) + offset
        # The clean words that score highest join those that training sets against the toxic ones.
        hard = np.flatnonzero((seen_clean > 0) & (score > -0.5))
        against = np.union1d(against, hard)
    worst = np.full(len(label), MILDEST)
    np.maximum.at(worst, text, score[word])
    worst, label = worst[kept], label[kept]
    slope, shift = _logistic(worst, label.astype(float))
    # Toxic texts mostly hold several insults in full, so the curve's middle lies high. It moves down to just
    # above what clean texts reach, where inserted characters still count.
    middle = -shift / slope
    reached = float(np.quantile(worst[label == 0], 0.998))
    shift = -slope * min(middle, max(reached + 0.3, middle / 2))
    return Model(model_weights.astype(np.float32), offset, slope, shift, chosen)


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = TRAINING_TEXTS) -> Model:
    """Model of the labelled texts: at most ``most`` of each kind, chosen by a hash of their id.

    The bounded sample is trained on in one task, and only the model comes to the driver. Ids that are labelled both ways
    count as toxic; null labels and others than 0 and 1 are left out.
    """
    known = labels.where(allowed & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = [
        known.where(F.col("_label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind in (0, 1)
    ]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice ``most`` rows
    rows = texts(docs).join(picked, "doc_id").select("doc_id", "text", F.col("_label").cast("int"))

    def run(batches):
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        model = train([(text, kind) for _, text, kind in rows])
        yield pa.RecordBatch.from_pydict(
            {
                "weights": pa.array([model.weights.tobytes()], pa.binary()),
                "numbers": pa.array([[model.offset, model.slope, model.shift]], pa.list_(pa.float64())),
                "landmarks": pa.array([model.landmarks], pa.list_(pa.string())),
            }
        )

    fitted = rows.repartition(1).mapInArrow(run, "weights binary, numbers array<double>, landmarks array<string>").first()
    if fitted is None:
        return train([])
    return Model(np.frombuffer(fitted["weights"], np.float32), *fitted["numbers"], list(fitted["landmarks"]))


def score(text: Column, model: Model) -> Column:
    """Toxicity of a text from 0 to 1."""
    weights, offset = model.weights, model.offset

    @F.arrow_udf(T.DoubleType())
    def rate(column: pa.Array) -> pa.Array:
        words, codes, owner = words_of(column)
        worst = np.full(len(column), MILDEST)
        np.maximum.at(worst, owner, (scores(words, weights) + offset)[codes])
        return pa.array(model.curve(worst))

    return rate(F.coalesce(text, F.lit("")))
