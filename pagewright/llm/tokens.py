"""Byte-level BPE ids inside tasks. The merge ranks and the split pattern are read from the given files.

``byte_bpe_50k.json`` and ``byte_bpe_50k.tiktoken`` hold one vocabulary; the second's library gives the same ids
several times faster (tested against the first). Special strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Longer texts are encoded in parts, cut before a single space between two other characters, where ids never join.
PART_CHARS = 1 << 20
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(name: str = RANKS) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})


def parts(text: str) -> list[str]:
    out, lo = [], 0
    while len(text) - lo > PART_CHARS and (cut := SAFE_CUT.search(text, lo + PART_CHARS)):
        out.append(text[lo : cut.start()])
        lo = cut.start()
    return [*out, text[lo:]]


def encode(text: str) -> np.ndarray:
    """Ids of ``text`` (uint32)."""
    e = encoding()
    if len(text) <= PART_CHARS:
        return np.frombuffer(array("I", e.encode_ordinary(text)), np.uint32)
    return np.concatenate([np.frombuffer(array("I", e.encode_ordinary(p)), np.uint32) for p in parts(text)])


@lru_cache(maxsize=2)
def token_bytes(name: str = RANKS) -> np.ndarray:
    """By id: bytes of the token."""
    r = ranks(name)
    out = np.zeros(max(r.values()) + 1, np.int64)
    out[np.fromiter(r.values(), np.int64)] = [len(t) for t in r]
    return out


#: White space as the split pattern sees it.
WHITE = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
LAST_WHITE = int(WHITE.max())
IS_WHITE = np.isin(np.arange(LAST_WHITE + 2), WHITE)


def cuts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in ``text`` where ids of both sides add up to those of the whole, how many ids lie before each, and all ids.

    Those are ends of tokens, in the midst of a pre-token or not: no merge crosses them, so either side merges as it did.
    Left out are ends within a character, those between white space and what follows it (where white space stands at
    the end of a text it is split in another way), and those before an apostrophe (which might begin a contraction).
    """
    ids = encode(text)
    at, before = np.cumsum(token_bytes()[ids]), np.arange(1, len(ids) + 1)
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):  # bytes are characters
        points = data
    else:
        begins = np.append((data & 0xC0) != 0x80, True)
        whole = begins[at]
        before, at = before[whole], np.cumsum(begins)[at[whole]] - 1
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(at) and at[-1] == len(points):
        at, before = at[:-1], before[:-1]
    white = lambda x: IS_WHITE[x if x.dtype == np.uint8 else np.minimum(x, LAST_WHITE + 1)]
    right = points[at]
    safe = (~white(points[at - 1]) | white(right)) & (right != ord("'"))
    return at[safe], before[safe], len(ids)


@lru_cache(maxsize=2)
def sentence_ends(name: str = RANKS) -> np.ndarray:
    """By id: whether a sentence may end after the token (it ends in . ! or ?, or holds a line break)."""
    r = ranks(name)
    out = np.zeros(max(r.values()) + 2, bool)
    for token, i in r.items():
        out[i] = token[-1:] in (b".", b"!", b"?") or b"\n" in token
    return out
