"""Substring deduplication by content-defined chunks.

A gear hash rolls over the last 16 bytes. A chunk ends at a word's start whose hash is the least among the three
words before and after, so a boundary depends on seven words of content only: after an insertion the next boundary is
where it was before, and chunks have about seven words. Inside a stretch of more than ``LONG`` bytes without white space (unspaced
scripts, minified code, base64) a chunk also ends at a code point's start whose hash is the least within ``REACH``
bytes before and after. Only where neither gives an end for ``MAX_CHUNK`` bytes, as in one letter repeated, is the cut
counted from the last end. Chunks are known by digest. A chunk is a
duplicate where a document with a smaller doc_id, or an earlier place in the same one, has it. Duplicates that
follow one another for at least ``MIN_RUN`` bytes are a repeated passage and are cut out; shorter ones stay, so chance
agreements (and digests that collide) change nothing. Every chunk stays in the first document that has it.

Only (digest, doc_id) pairs are shuffled to find duplicates, once for each document that holds a chunk; the first
holder is found by a minimum with partial aggregation, and met by a join that can split a very common chunk.

Rows: null and empty texts stay as they are; very long texts are cut whole, each in one task's memory; rows without doc_id, or that
share one with another row, lose only what repeats within them or in smaller doc_ids, so of rows that repeat under one doc_id each keeps its text;
an empty table gives an empty result; other columns stay, but for those named as one of the report's, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from verbaspark.llm.encoding import flat_text
from verbaspark.llm.tables import chunks, documents, id_and_text, map_arrow
from verbaspark.runtime import materialize

WINDOW = 16
#: A boundary's hash is the least among so many words before it and after it.
AROUND = 3
MAX_CHUNK, MIN_RUN = 1024, 100
#: In stretches of more than LONG bytes without white space, an end's hash is the least among REACH bytes either way.
LONG, REACH = 128, 32
_GEAR = np.array([xxh64_intdigest(bytes([b])) & 0xFFFF for b in range(256)] + [0], np.uint16)


def gear_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[byte i], 16 bits, afresh from each text's start; in log steps, not byte by byte."""
    n, k = len(data), len(starts)
    # Texts stand WINDOW places apart, whose gear is zero, so that no hash reaches into the text before.
    where = np.arange(n)
    where += np.repeat(np.arange(1, k + 1) * WINDOW, np.diff(np.append(starts, n)))
    h = np.zeros(n + k * WINDOW, np.uint16)
    h[where] = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
        step *= 2
    return h[where]


def unspaced_ends(raw: np.ndarray, h: np.ndarray, white: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends inside long stretches without white space."""
    begins = np.append(False, white)
    begins[starts] = True
    first = np.flatnonzero(begins[:-1])
    stop = np.append(first[1:], len(raw))
    long = stop - first > LONG + 1
    if not long.any():
        return np.zeros(0, np.int64)
    # A stretch's first byte is left out, so places k apart in this array are k bytes apart only within one stretch.
    at = np.concatenate([np.arange(a + 1, b) for a, b in zip(first[long].tolist(), stop[long].tolist(), strict=True)])
    may = ~white[at] & ((raw[at] & 0xC0) != 0x80)
    hashed, least = np.where(may, h[at - 1].astype(np.int32), 1 << 16), may.copy()
    for k in range(1, REACH + 1):
        apart = at[k:] - at[:-k] != k
        least[k:] &= apart | (hashed[k:] < hashed[:-k])
        least[:-k] &= apart | (hashed[:-k] <= hashed[k:])
    return at[least]


def chunk_ends(data: bytes, sizes: np.ndarray) -> list[list[int]]:
    """For each text, the ends of its chunks as byte offsets in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(raw):
        return [[] for _ in sizes]
    h = gear_hashes(raw, starts)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    text = np.searchsorted(starts, at, "right")
    inner = starts[text - 1] != at
    at, text = at[inner], text[inner]
    hashed, least = h[at - 1], np.ones(len(at), bool)
    for k in range(1, min(AROUND, len(at) - 1) + 1):
        apart = text[k:] != text[:-k]
        least[k:] &= apart | (hashed[k:] < hashed[:-k])
        least[:-k] &= apart | (hashed[:-k] <= hashed[k:])
    at, more = at[least], unspaced_ends(raw, h, white, starts)
    if len(more):
        at = np.sort(np.concatenate([at, more]))
    cut, stop = np.searchsorted(at, starts, "right").tolist(), np.searchsorted(at, ends, "left").tolist()
    at = at.tolist()
    out = []
    for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        mine, last = [], start
        for p in at[cut[k] : stop[k]] + [end] * (end > start):
            while p - last > MAX_CHUNK:
                last += MAX_CHUNK
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                mine.append(last)
            mine.append(p)
            last = p
        out.append(mine)
    return out


def digests(data: bytes, start: int, ends: list[int]) -> list[int]:
    """Signed 64-bit digests of a text's chunks."""
    out = []
    for end in ends:
        d = xxh3_64_intdigest(data[start:end])
        out.append(d - (1 << 64) if d >> 63 else d)
        start = end
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """digest and doc_id of every chunk, once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, sizes = flat_text(batch.column(1))
            ids, found, counts = batch.column(0).to_numpy(zero_copy_only=False), [], []
            at = 0
            for n, ends in zip(sizes.tolist(), chunk_ends(data, sizes), strict=True):
                mine = set(digests(data, at, ends))
                found += mine
                counts.append(len(mine))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.repeat(ids, counts), pa.int64())], ["digest", "doc_id"])

    return map_arrow(id_and_text(docs).where("doc_id is not null and text != ''"), run, "digest long, doc_id long")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of its chunks that a document with a smaller doc_id has."""
    seen = materialize(occurrences(docs), "chunks")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = seen.join(first, "digest").where("doc_id != first")
    return later.groupBy("doc_id").agg(F.collect_set("digest").alias("repeated"))


def passages(ends: list[int], start: int, found: list[int], known: set[int]) -> tuple[list[tuple[int, int]], int]:
    """Start and end of each run of duplicates that is long enough, and the number of duplicate chunks."""
    out, seen, run, count = [], set(), start, 0
    for end, d in zip(ends, found, strict=True):
        if d in known or d in seen:
            count += 1
        else:
            if start - run >= MIN_RUN:
                out.append((run, start))
            run = end
            seen.add(d)
        start = end
    if start - run >= MIN_RUN:
        out.append((run, start))
    return out, count


def unused(name: str, names: list[str]) -> str:
    """``name``, or that with marks before it until no column has it."""
    taken = {n.lower() for n in names}
    while name in taken:
        name = f"_{name}"
    return name


def dedup(docs: DataFrame, report: bool = True) -> DataFrame:
    """``docs`` without the repeated passages in ``text``, and, with ``report``, n_chunks, n_duplicate_chunks, removed_bytes and
    removed (start:end in code points of the text before, joined by commas)."""
    if report:
        docs = docs.select([c for c in docs.columns if c.lower() not in MORE])
    names, at = docs.columns, docs.columns.index("text")
    held, doc = unused("held", names), unused("held_by", names)
    known = repeated(docs.select("doc_id", "text")).select(F.col("doc_id").alias(doc), F.col("repeated").alias(held))
    # Rows without doc_id would meet in one task; a sorted merge spills, and splits a doc_id that too many rows have.
    joined = docs.where("doc_id is not null").join(known.hint("merge"), F.col("doc_id") == F.col(doc), "left").select(*names, held)
    joined = joined.unionByName(docs.where("doc_id is null").withColumn(held, F.lit(None).cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, sizes = flat_text(batch.column(at))
            cols: list[list] = [[] for _ in range(5)]
            start = 0
            texts = batch.column(at).to_pylist()
            for text, n, ends, known in zip(texts, sizes.tolist(), chunk_ends(data, sizes), batch.column(len(names)).to_pylist(), strict=True):
                cuts, count = passages(ends, start, digests(data, start, ends), set(known or ()))
                kept, spans, done, chars = [], [], start, 0
                for a, b in cuts:
                    before, gone = data[done:a].decode(), data[a:b].decode()
                    kept.append(before)
                    chars += len(before)
                    spans.append(f"{chars}:{chars + len(gone)}")
                    chars += len(gone)
                    done = b
                new = "".join(kept) + data[done : start + n].decode() if cuts else text
                for col, x in zip(cols, (new, len(ends), count, sum(b - a for a, b in cuts), ",".join(spans)), strict=True):
                    col.append(x)
                start += n
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            new, *more = (pa.array(c, t) for c, t in zip(cols, types, strict=True))
            more = more if report else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 : -1], *more], [*names, *MORE[: len(more)]])

    schema = StructType([*docs.schema.fields])
    for name, kind in zip(MORE, ("long", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind) if report else schema
    return map_arrow(joined, run, schema)


MORE = ["n_chunks", "n_duplicate_chunks", "removed_bytes", "removed"]


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))
