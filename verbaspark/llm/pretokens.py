"""Splitting whole batches of texts into pre-tokens with array operations.

The rules are those of the byte-level pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
and of its variant for lower-cased words, where each number stands alone and white space is dropped.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: The Unicode property White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kinds = np.array(kinds)
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    table[_WHITE] = SPACE
    return table


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)


def split(data: bytes, text_bytes: np.ndarray, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of texts that lie one after another in ``data``, with ``text_bytes`` bytes each.

    Returns the byte offsets of the pre-tokens (they tile ``data``; one more offset than tokens), the
    number of pre-tokens of each text, and which pre-tokens begin with white space. ``words``: the
    variant for lower-cased words; its white-space tokens are still there and carry no ids.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(text_bytes), np.int64), np.zeros(0, bool)
    cp = code_points(data)
    n = len(cp)
    raw = np.frombuffer(data, np.uint8)
    byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    text_start = np.searchsorted(byte_at, np.cumsum(text_bytes) - text_bytes)
    first = np.zeros(n + 1, bool)
    first[text_start] = True
    first[n] = True
    cls = char_classes()[cp]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, cls[:-1]
    before[first[:n]] = END
    start = cls != before
    if words:
        start |= cls == NUMBER
    else:
        solid = (cls != SPACE) & (before == SPACE)
        at = np.flatnonzero(solid)
        start[at - 1] = True
        start[at[cp[at - 1] == 32]] = False
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        end = np.append(text_start[1:], n)
        last = end[np.searchsorted(text_start, quote, "right") - 1]
        one = np.where(quote + 1 < last, cp[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < last, cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            after = hit + size
            start[after[after < n]] = True
    at = np.flatnonzero(start)
    offsets = np.append(byte_at[at], byte_at[n])
    bounds = np.append(np.searchsorted(at, text_start), len(at))
    return offsets, np.diff(bounds), cls[at] == SPACE


def distinct(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pre-tokens: their bytes in a row with offsets, and the place among them of each pre-token.

    Up to seven bytes are told apart as packed integers, longer ones by Arrow's dictionary.
    """
    sizes = np.diff(offsets)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(len(data), "<u8", padded, strides=(1,))
    place = np.empty(len(sizes), np.int64)
    short = np.flatnonzero((sizes <= 7) & (sizes > 0))
    n = sizes[short].astype(np.uint64)
    keys = words[offsets[short]] & ((np.uint64(1) << (n << np.uint64(3))) - np.uint64(1)) | n << np.uint64(56)
    place[short], keys = pd.factorize(keys)
    size = (keys >> np.uint64(56)).astype(np.int64)
    rows = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    part = rows[np.arange(8) < size[:, None]]
    long = np.flatnonzero(sizes > 7)
    flat = spread(long, padded, offsets[:-1], sizes)
    array = pa.Array.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(np.append(0, np.cumsum(sizes[long]))), pa.py_buffer(flat)])
    coded = array.dictionary_encode()
    place[long] = coded.indices.to_numpy() + len(keys)
    if len(coded.dictionary):
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
        more = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[: ends[-1]]
    else:
        ends, more = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.append(0, np.cumsum(size))
    return np.append(part, more), np.append(at, ends[1:] + at[-1]), place


def spread(which: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[w]:starts[w]+counts[w]]`` over all w in ``which``."""
    sizes = counts[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - ends + sizes, sizes) + np.arange(total)]
