"""Token ids in rANS blocks: shared frequencies, interleaved lanes, checkpoints and checksums.

The container is a folder of two Parquet tables: the shared table of frequencies, and the blocks in ascending order of doc_id,
one part file for each range of documents. Spark writes and commits both, so that a lost executor costs only its own
tasks, and the folder is all that a reader needs. A block holds whole documents and can be decoded alone with the table;
each of its segments starts at a checkpoint (the lanes' states and the place in the stream) and can be decoded alone
too. Checksums cover every segment's ids, the block's bytes and the frequencies.

Ids lie in 16 bits before they are coded: a vocabulary with larger ones is an error, never cut.

Rows: null text counts as empty and holds only the end id; null doc_ids come first; rows that share a doc_id are in the order of a
hash of their ids, and equal rows next to one another, in any order; very long texts are read whole, each in one block; an empty
table gives empty files; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.llm.encoding import encode_texts
from verbaspark.llm.tables import chunks, documents, id_and_text, map_arrow
from verbaspark.runtime import materialize, shared_dir

MAGIC = b"RANS0001"
SCALE = 20
LANES = 2048
SEGMENT = 128
BLOCK_IDS = LANES * SEGMENT * 2
_LOW = np.uint64(1 << 31)
_S, _32 = np.uint64(SCALE), np.uint64(32)


def quantized(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each id that occurs."""
    counts = np.asarray(counts, np.float64)
    total, room = counts.sum(), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    used = counts > 0
    freq = np.where(used, 1 + np.floor(counts / total * (room - used.sum())), 0).astype(np.int64)
    freq[int(np.argmax(counts))] += room - freq.sum()
    return freq


class Coder:
    """Encodes and decodes arrays of ids by one table of frequencies."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        steps = -(-n // LANES)
        state = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = []
        points: list[tuple[int, np.ndarray]] = []
        count = 0
        for step in range(steps - 1, -1, -1):
            part = ids[step * LANES : (step + 1) * LANES]
            x = state[: len(part)]
            f = self.freq[part]
            full = x >= (f << np.uint64(63 - SCALE))
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            count += len(words[-1])
            x = np.where(full, x >> _32, x)
            q = x // f
            state[: len(part)] = (q << _S) + (x - q * f) + self.cum[part]
            if step % SEGMENT == 0:
                points.append((count, state.copy()))
        words.reverse()
        stream = np.concatenate(words).tobytes() if words else b""
        out = [struct.pack("<II", n, len(points))]
        for k, (left, states) in enumerate(reversed(points)):
            crc = zlib.crc32(ids[k * SEGMENT * LANES : (k + 1) * SEGMENT * LANES].astype("<u4"))
            out += [struct.pack("<II", count - left, crc), states.astype("<u8").tobytes()]
        return b"".join([*out, stream])

    @staticmethod
    def segments(data: bytes) -> int:
        return struct.unpack_from("<II", data)[1]

    def decode_segment(self, data: bytes, k: int) -> np.ndarray:
        """The ids of segment k alone; raises where they do not match their checksum."""
        n, points = struct.unpack_from("<II", data)
        at = 8 + k * (8 + 8 * LANES)
        word, crc = struct.unpack_from("<II", data, at)
        x = np.frombuffer(data, "<u8", LANES, at + 8).copy()
        words = np.frombuffer(data, "<u4", offset=8 + points * (8 + 8 * LANES))
        first, last = k * SEGMENT * LANES, min(n, (k + 1) * SEGMENT * LANES)
        out = np.empty(last - first, np.int32)
        mask = np.uint64((1 << SCALE) - 1)
        for at in range(0, last - first, LANES):
            size = min(LANES, last - first - at)
            y = x[:size]
            slot = y & mask
            s = self.symbol[slot.astype(np.int64)]
            out[at : at + size] = s
            y = self.freq[s] * (y >> _S) + slot - self.cum[s]
            low = np.flatnonzero(y < _LOW)
            y[low] = (y[low] << _32) | words[word : word + len(low)]
            word += len(low)
            x[:size] = y
        if zlib.crc32(out.astype("<u4")) != crc:
            raise ValueError("a segment's ids do not match their checksum")
        return out

    def decode(self, data: bytes) -> np.ndarray:
        parts = [self.decode_segment(data, k) for k in range(self.segments(data))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def pack_block(coder: Coder, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    has = np.array([x is not None for x in doc_ids], np.uint8)
    head = [MAGIC, struct.pack("<I", len(counts)), has.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(counts, "<i8").tobytes()]
    body = b"".join([*head, coder.encode(ids)])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(coder: Coder, block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, counts and all ids of a block; raises where its bytes do not match their checksum."""
    body = block[:-4]
    if body[:8] != MAGIC or zlib.crc32(body) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block is damaged")
    n = struct.unpack_from("<I", body, 8)[0]
    has = np.frombuffer(body, np.uint8, n, 12)
    ids = np.frombuffer(body, "<i8", n, 12 + n).tolist()
    counts = np.frombuffer(body, "<i8", n, 12 + 9 * n)
    return [x if h else None for x, h in zip(ids, has.tolist(), strict=True)], counts, coder.decode(body[12 + 17 * n :])


def tokenize(docs: DataFrame, path: str, end_id: int, words: bool = False) -> DataFrame:
    """doc_id, n and the ids as little-endian 16-bit integers (the vocabulary is below 65,536), the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, counts = encode_texts(path, batch.column(1), words)
            if max(end_id, int(ids.max(initial=0))) > 0xFFFF:
                raise ValueError("an id beyond 16 bits: the vocabulary is too large for this container")
            ends = np.cumsum(counts)
            ids = np.insert(ids.astype("<u2"), ends, np.uint16(end_id))
            at = np.append(0, np.cumsum(counts + 1)) * 2
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1, pa.int64()), packed], ["doc_id", "n", "ids"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; one row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = map_arrow(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r.id for r in rows), default=0), np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_container(tokens: DataFrame, path: str) -> None:
    """The container below ``path``: ``frequencies``, and ``blocks`` with the file each lies in and the ids before it there."""
    spark, freq = tokens.sparkSession, quantized(id_counts(tokens))
    crc = zlib.crc32(freq.astype("<i8"))
    spark.createDataFrame(pa.table({"id": np.arange(len(freq)), "freq": freq, "crc": np.full(len(freq), crc)})).coalesce(1).write.parquet(f"{path}/frequencies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, first = Coder(freq), TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[int] = []
        parts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            data = pack_block(coder, docs, counts, np.frombuffer(b"".join(parts), "<u2").astype(np.int32))
            return pa.RecordBatch.from_pydict({"file": [file], "first": [first], "n": [size], "block": [data]}, schema=pa.schema([("file", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("block", pa.binary())]))

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if size and size + n > BLOCK_IDS:
                    yield block()
                    first, size = first + size, 0
                    docs, counts, parts = [], [], []
                docs.append(doc)
                counts.append(n)
                parts.append(ids)
                size += n
        if size:
            yield block()

    # Rows that share a doc_id are parted by their ids, and equal ones by their place, so no key is too large for a range.
    ordered = tokens.repartitionByRange("doc_id", F.xxhash64("ids"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    map_arrow(ordered, run, "file long, first long, n long, block binary").write.parquet(f"{path}/blocks")


def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    """The container's table, a row for each id of the vocabulary; raises where it does not match its checksum."""
    rows = spark.read.schema("id long, freq long, crc long").parquet(f"{path}/frequencies").toArrow().sort_by("id")
    ids, freq, crc = (rows.column(c).to_numpy() for c in ("id", "freq", "crc"))
    if (ids != np.arange(len(ids))).any() or (crc != zlib.crc32(freq.astype("<i8"))).any():
        raise ValueError("the table of frequencies is damaged")
    return freq


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the container."""
    freq = read_frequencies(spark, path)
    blocks = spark.read.schema("file long, first long, n long, block binary").parquet(f"{path}/blocks")
    before, base = 0, {}
    for r in blocks.groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect():  # one row for each file
        base[r.file] = before
        before += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for file, first, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs, counts, ids = unpack_block(coder, data)
                packed, ends = ids.astype("<u4"), np.cumsum(counts)
                crc = [zlib.crc32(packed[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base[file] + first + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(blocks.select("file", "first", "block"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = materialize(tokenize(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0), "tokens")
    path = shared_dir(spark)
    write_container(tokens, path)
    return read_container(spark, path)
