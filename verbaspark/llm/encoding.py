"""Ids of a whole batch of texts by the tokenizers library, and how a batch's texts lie in memory."""

from __future__ import annotations

import functools
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from verbaspark.llm import pretokens

#: Pre-tokens that each of the memo's two generations holds at most, and the longest in bytes that it holds.
MEMO, MEMO_BYTES = 1 << 18, 64


def byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: itself where it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


_SIGNS = byte_signs()


class LibraryIds:
    """Ids of distinct pre-tokens by the tokenizers library; those seen lately are looked up.

    The memo has two generations: when the younger is full, the older goes. It changes no result.
    """

    def __init__(self, path: str, normalized: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.normalized = normalized
        if normalized:  # the whole texts already are; a part alone may order its marks anew
            self.library.normalizer = None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _remember(self, token: bytes, ids: bytes) -> None:
        if len(token) <= MEMO_BYTES:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[token] = ids

    def _fresh(self, tokens: list[bytes]) -> Iterator[bytes]:
        """The ids of pre-tokens by the library; a byte-level one goes to its model at once, since it need not be split again."""
        if not self.normalized:
            model = self.library.model
            return (array("i", [t.id for t in model.tokenize(token.decode("latin-1").translate(_SIGNS))]).tobytes() for token in tokens)
        return (array("i", e.ids).tobytes() for e in self.library.encode_batch_fast([token.decode() for token in tokens], add_special_tokens=False))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens ``data[offsets[i]:offsets[i+1]]``: all ids in a row, and how many each has."""
        raw, at = data.tobytes(), offsets.tolist()
        tokens = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        out = list(map(self.young.get, tokens))
        fresh = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = out[i] = self.old.get(tokens[i])
            if ids is None:
                fresh.append(i)
            else:
                self._remember(tokens[i], ids)
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            for i, ids in zip(part, self._fresh([tokens[i] for i in part]), strict=True):
                out[i] = ids
                self._remember(tokens[i], ids)
        return np.frombuffer(b"".join(out), np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4


@functools.lru_cache(3)
def library_ids(path: str, normalized: bool = False) -> LibraryIds:
    return LibraryIds(path, normalized)


def flat_text(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a column's texts in a row, and the number of bytes of each; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (data.to_pybytes()[ends[0] : ends[-1]] if data is not None and len(ends) else b""), np.diff(ends)


def lowered(texts: list[str]) -> list[str]:
    """NFC, then lower case letter by letter (no special end-of-word sigma)."""
    out = []
    for text in texts:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        out.append(text.lower())
    return out


@functools.cache
def disputed() -> np.ndarray:
    """Code points that versions of Unicode hold for different: unassigned here, or with newer orders or decompositions."""
    old, now = unicodedata.ucd_3_2_0, unicodedata
    return np.array([now.category(c) == "Cn" or now.combining(c) != old.combining(c) or now.decomposition(c) != old.decomposition(c) for c in map(chr, range(0x110000))])


def encode_texts(path: str, column: pa.Array, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids by the vocabulary file at ``path``: all ids in a row, and how many each text has.

    ``words``: the file lower-cases, drops white space and marks ends of words; else it is byte-level.
    Texts with disputed code points go through the library as a whole.
    """
    column = column.fill_null("")
    texts, data = column.to_pylist(), flat_text(column)[0]
    hits = [] if data.isascii() else np.flatnonzero(disputed()[pretokens.code_points(data)])
    whole = np.unique(np.searchsorted(np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False)), hits, "right")).tolist() if len(hits) else []
    encoded = library_ids(path).library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else []
    for i in whole:
        texts[i] = ""
    ids, counts = _by_parts(path, pa.array(lowered(texts) if words else texts, pa.large_string()), words)
    if whole:
        sizes = [len(e.ids) for e in encoded]
        ids = np.insert(ids, np.repeat(np.cumsum(counts)[whole], sizes), np.concatenate([np.array(e.ids, np.int32) for e in encoded]))
        counts[whole] = sizes
    return ids, counts


def _by_parts(path: str, column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    data, sizes = flat_text(column)
    offsets, tokens, white = pretokens.split(data, sizes, words)
    if len(offsets) < 2:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    flat, at, place = pretokens.distinct(data, offsets)
    ids, counts = library_ids(path, words).encode(flat, at)
    starts = np.cumsum(counts) - counts
    if words:
        counts[place[white]] = 0
    return pretokens.spread(place, ids, starts, counts), per_text(counts[place], tokens)


def per_text(values: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's tokens."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(tokens)
    return total[ends] - total[ends - tokens]
