"""Byte-level BPE with a two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap for the rest.

Rows: null text counts as empty and gives no ids; empty and very long texts, ties and repeated rows are
ordinary; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from verbaspark.llm import pretokens
from verbaspark.llm.bpe import merge_by_heap, read_ranks
from verbaspark.llm.encoding import flat_text, per_text
from verbaspark.llm.minimal_hash import MinimalPerfectHash
from verbaspark.llm.tables import chunks, documents, id_and_text, map_arrow

#: Pre-tokens outside the vocabulary that a worker remembers; beyond, it starts anew.
REMEMBERED = 150_000
_BASE = np.uint64(0x100000001B3)


def hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A polynomial hash of 64 bits of each byte string ``flat[at[i]:at[i+1]]``."""
    sizes = np.diff(at)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    longest = int(sizes.max(initial=1))
    power = np.cumprod(np.append(np.uint64(1), np.full(max(longest - 1, 0), _BASE, np.uint64)), dtype=np.uint64)
    where = np.arange(len(flat)) - np.repeat(at[:-1], sizes)
    sums = np.append(np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[where], dtype=np.uint64))
    return sums[at[1:]] - sums[at[:-1]]


class TwoTierBPE:
    def __init__(self, path: str):
        tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.tokens = tokens
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.at = np.append(0, np.cumsum(self.sizes))
        self.first = [self.rank[bytes([b])] for b in range(256)]
        self.whole = MinimalPerfectHash(hashes(self.bytes, self.at))
        self.seen: dict[bytes, list[int]] = {}

    def find_whole(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First tier: the id of each byte string that is in the vocabulary, else -1; the bytes are compared."""
        sizes = np.diff(at)
        found = self.whole.find(hashes(flat, at))
        found[(found >= 0) & (self.sizes[found] != sizes)] = -1
        hit = np.flatnonzero(found >= 0)
        here = pretokens.spread(hit, flat, at[:-1], sizes)
        there = pretokens.spread(found[hit], self.bytes, self.at[:-1], self.sizes)
        wrong = np.append(0, np.cumsum(here != there))
        ends = np.cumsum(sizes[hit])
        found[hit[wrong[ends] != wrong[ends - sizes[hit]]]] = -1
        return found

    def _pair(self, a: int, b: int):
        made = self.rank.get(self.tokens[a] + self.tokens[b])
        return None if made is None else (made, made)

    def merge(self, token: bytes) -> list[int]:
        """Second tier: a heap over the linked bytes."""
        ids = self.seen.get(token)
        if ids is None:
            ids = merge_by_heap([self.first[b] for b in token], self._pair)
            if len(token) <= 256:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[token] = ids
        return ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        data, sizes = flat_text(column)
        offsets, tokens, _ = pretokens.split(data, sizes)
        if len(offsets) < 2:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        flat, at, place = pretokens.distinct(data, offsets)
        whole = self.find_whole(flat, at)
        miss = np.flatnonzero(whole < 0)
        raw = flat.tobytes()
        merged = [self.merge(raw[a:b]) for a, b in zip(at[miss].tolist(), at[miss + 1].tolist(), strict=True)]
        counts = np.ones(len(whole), np.int64)
        counts[miss] = [len(x) for x in merged]
        starts = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        hit = np.flatnonzero(whole >= 0)
        ids[starts[hit]] = whole[hit]
        ids[pretokens.spread(miss, np.arange(len(ids)), starts, counts)] = [i for x in merged for i in x]
        return pretokens.spread(place, ids, starts, counts), per_text(counts[place], tokens)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, in a row."""
        return pretokens.spread(ids, self.bytes, self.at[:-1], self.sizes)


@functools.lru_cache(2)
def two_tier(path: str) -> TwoTierBPE:
    return TwoTierBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text, by the rank file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = two_tier(path)
        for batch in chunks(batches):
            ids, counts = bpe.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return map_arrow(id_and_text(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``encode``'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = two_tier(path)
        for batch in chunks(batches):
            texts = [bpe.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode the ids again and return digests of both, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = two_tier(path)
        for batch in chunks(batches):
            ids, counts = bpe.encode(batch.column(1))
            raw = bpe.decode(ids)
            sizes = per_text(bpe.sizes[ids], counts)
            id_ends, ends = np.cumsum(counts), np.cumsum(sizes)
            packed = ids.astype("<u4")
            of_ids = [hashlib.sha256(packed[e - n : e]).hexdigest() for e, n in zip(id_ends.tolist(), counts.tolist(), strict=True)]
            of_text = [hashlib.sha256(raw[e - n : e]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
