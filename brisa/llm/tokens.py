"""Token ids of texts under a byte-level BPE vocabulary.

The vocabulary's pattern looks ahead only to group white space. A text without two white-space
characters side by side is cut the same way by the pattern without that part, which needs no
backtracking and takes little over half the time; other texts take the whole pattern.

A vocabulary is named by its tokenizer's .json, whose added tokens are taken out of any text before the rest is
encoded, or by a .tiktoken rank file, which has none. The ranks of a .json stand in the rank file beside it.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The part of the pattern that looks ahead, and white space as the pattern means it.
LOOK_AHEAD = r"|\s+(?!\S)"
SPACE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def kept_by_worker(name: str, build):
    """Something that a Python worker builds once and keeps for its later tasks."""
    module = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(module, name):
        setattr(module, name, build())
    return getattr(module, name)


def _encoders(path: str):
    import base64
    import json
    from functools import partial

    import tiktoken
    from public_tokenizers import PATTERN

    added = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            tokens = json.load(file)["added_tokens"]
        # Added tokens that also take the white space around them, or stand between words only, are cut otherwise.
        assert not any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
        added = {t["content"]: t["id"] for t in tokens}
        path = path.removesuffix("json") + "tiktoken"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = PATTERN.replace(LOOK_AHEAD, "")
    assert plain != PATTERN
    own = [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens=added) for p in (plain, PATTERN)]
    return [partial(e.encode, allowed_special="all") if added else e.encode_ordinary for e in own]


def encoders(path: str):
    """Functions text -> ids: for texts without white space side by side, and for any."""
    return kept_by_worker(f"encoders of {path}", lambda: _encoders(path))


def token_ids(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text of a column; none for a null."""
    plain, whole = encoders(path)
    spaced = pc.match_substring_regex(column, f"{SPACE}{{2}}")
    for text, side_by_side in zip(column, spaced):
        text = text.as_py()
        yield np.array((whole if side_by_side.as_py() else plain)(text) if text else [], np.uint32)
