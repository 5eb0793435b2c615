"""Media columns: progressive JPEG to full-resolution RGB tensors.

Rows: a null or damaged image, and one of more than ``most`` pixels, gives null height, width and rgb; a null text counts as empty
(64 zero bytes are stored); a very long text is one image, in one task's memory; rows that repeat, equal texts and equal images get
equal answers; a null key stays null; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaspark.llm import jpeg
from verbaspark.llm.encoding import flat_text
from verbaspark.llm.tables import chunks, documents, id_and_text, map_arrow


def tensors(images: DataFrame, key: str, column: str, most: int = jpeg.MOST_PIXELS) -> DataFrame:
    """``key``, height, width and rgb (height x width x 3 bytes) of the progressive JPEG files in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4 << 20):
            shapes, data = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    got = jpeg.decode(raw, most) if raw else None
                except (ValueError, IndexError, KeyError, TypeError, OverflowError, MemoryError, struct.error):  # whatever damaged bytes lead to
                    got = None
                shapes.append((None, None) if got is None else got.shape[:2])
                data.append(None if got is None else got.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in shapes], pa.int32()), pa.array([s[1] for s in shapes], pa.int32()), pa.array(data, pa.binary())], [key, "height", "width", "rgb"])

    df = images.select(key, F.col(column).cast("binary").alias("_image"))
    return map_arrow(df, run, f"{key} {df.schema[key].dataType.simpleString()}, height int, width int, rgb binary")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature(pixels: np.ndarray) -> str:
    """Size, channel means in thousandths, and a checksum of the tensor."""
    h, w = pixels.shape[:2]
    means = pixels.reshape(h, -1).sum(0, dtype=np.int64).reshape(w, 3).sum(0) * 1000 // (h * w)
    return f"{w}x{h}:{means[0]}:{means[1]}:{means[2]}:{zlib.crc32(pixels):08x}"


def stored(docs: DataFrame) -> DataFrame:
    """Store every text in an image and read it back from the image's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4 << 20):
            data, sizes = flat_text(batch.column(1))
            cols: list[list] = [[] for _ in range(7)]
            for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                media = jpeg.encode(padded(data[end - n : end]))
                image = jpeg.coefficients(media, len(media) * 64)
                back = jpeg.payload(image)
                for col, x in zip(cols, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(jpeg.rgb(image))), strict=True):
                    col.append(x)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    return map_arrow(id_and_text(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(documents(spark, sf_dir))
