"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's ids are hashed with signs into buckets and projected to a few dimensions, all in whole
numbers, so that equal texts lie at equal points. The points' Hilbert keys order the documents; the ids
in this order are cut every ``window`` ids, so that only the last sequence has padding.

Rows: null text counts as empty and holds only the end id; very long texts are cut into as many pieces as they need; ties on the curve, and
rows that repeat or share a doc_id, are packed one after another in the order they are read in, each row by itself; a null doc_id stays
null; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.llm.op10_rans import tokenize
from verbaspark.llm.tables import documents, map_arrow
from verbaspark.runtime import materialize

DIMENSIONS, BITS, BUCKETS = 4, 8, 256


def projection(vocabulary: int) -> np.ndarray:
    """What each id adds to a document's point: its signed bucket's row of a fixed random matrix."""
    random = np.random.default_rng(7)
    matrix = np.rint(random.normal(0, 256, (BUCKETS, DIMENSIONS))).astype(np.int64)
    hashed = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = 1 - 2 * (hashed >> np.uint64(63)).astype(np.int64)
    return matrix[(hashed >> np.uint64(48)).astype(np.int64) % BUCKETS] * sign[:, None]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def with_keys(tokens: DataFrame) -> DataFrame:
    """Adds ``row`` (a number of its own for each row) and ``key`` (the Hilbert key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.ascontiguousarray(c) for c in projection(1 << 16).T]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.column(1).to_numpy()
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2")
            starts = np.cumsum(n) - n
            sums = np.stack([np.add.reduceat(c[ids], starts) for c in table], 1)
            # A mean of unit spread is about 256 / sqrt(n) wide; most of what tells texts apart lies within +-64.
            points = np.clip((sums * 2 // n[:, None]) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), *batch.columns, pa.array(hilbert_keys(points, BITS))], ["row", "doc_id", "n", "ids", "key"])
            row += len(n)

    return map_arrow(tokens, run, "row long, doc_id long, n long, ids binary, key long")


def positions(keyed: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Each row's part and the ids before it there, and the ids before each part, in Hilbert order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), batch.column(1)], ["row", "part", "before", "n"])
            before = int(ends[-1]) if len(n) else before

    ordered = keyed.select("row", "n", "key").repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("row", "n")
    placed = materialize(map_arrow(ordered, run, "row long, part long, before long, n long"), "order")
    base, total = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row for each part
        base[r.part] = total
        total += r.n
    return placed.drop("n"), base


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """The pieces of all documents in sequences of ``window`` ids."""
    keyed = materialize(with_keys(tokenize(docs, path, end_id, words=True)), "keyed")
    placed, base = positions(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n, ids, part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, ids = base[part] + before, np.frombuffer(ids, "<u2").astype("<u4")
                cuts = [0, *range(window - at % window, n, window), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    out.append((doc, a, b - a, zlib.crc32(ids[a:b]), n, (at + a) // window, (at + a) % window))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # The side to hash has 24 bytes a document, where the other has all its ids.
    joined = keyed.select("row", "doc_id", "n", "ids").join(placed.hint("shuffle_hash"), "row").select("doc_id", "n", "ids", "part", "before")
    return map_arrow(joined, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
