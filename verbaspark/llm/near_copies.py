"""Near-duplicate texts: candidates by MinHash bands and by SimHash, verified by exact similarity of 5-word shingles.

At similarity 0.8 two 64-bit fingerprints lie about ten bits apart, where neither bit ranges nor trees narrow a search.
So candidates come from ``BANDS`` bands of ``ROWS`` minima each (a pair at 0.8 shares a band in all but 7 of 100,000 cases,
and higher pairs more surely) and from the components of operator 9. Texts with equal words are one node from
the start. Nodes that share a bucket are compared by their words: first with a leader of the bucket, ``TURNS`` times
over; a bucket that then still holds several components is settled whole, by shared shingles, in shards of at most two
blocks. So a large group of close copies costs no square of its size; many texts just below 0.8 in one bucket still do, in
one task's counts and not in rows. No pair of a bucket is left out but those that are joined already.

Rows: null text counts as empty; texts without words are copies of one another; a text of fewer than five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from verbaspark.llm.components import components
from verbaspark.llm.encoding import flat_text
from verbaspark.llm.op9_simhash import near_duplicates
from verbaspark.llm.tables import chunks, map_arrow
from verbaspark.runtime import materialize, scratch

SIZE = 5
BANDS, ROWS, TURNS = 24, 5, 3
#: Rows in a block of a bucket that the leaders have not settled.
BLOCK = 1024
_RANDOM = np.random.default_rng(20)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> set[bytes]:
    """The 5-word shingles of a UTF-8 text; words as in operator 9."""
    words = text.lower().split()
    return {b" ".join(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))} if words else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is 0.8 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def buckets(text: bytes) -> np.ndarray:
    """A key for each band of minima; none for a text without words."""
    hashed = np.fromiter((xxh64_intdigest(s) for s in shingles(text)), np.uint64)
    if not len(hashed):
        return np.zeros(0, np.int64)
    least = np.full(len(_TIMES), ~np.uint64(0))
    for at in range(0, len(hashed), 512):
        h = hashed[at : at + 512, None] * _TIMES + _PLUS
        least = np.minimum(least, (h >> np.uint64(32)).min(0))
    raw = least.reshape(BANDS, ROWS).astype("<u8")
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(raw)], np.uint64).view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """row, digest of the words and bucket keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, sizes = flat_text(batch.column(1))
            ends = np.cumsum(sizes).tolist()
            texts = [data[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
            digest = pa.array([xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], pa.binary())
            keys = pa.array([buckets(t).tolist() for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, keys], ["row", "digest", "keys"])

    return map_arrow(rows.select("row", F.coalesce("text", F.lit("")).alias("text")), run, "row long, digest binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of rows whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch]):
                last, known = None, set()
                u, v = [], []
                for a, b, x, y in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    if a != last:
                        last, known = a, shingles(x.encode())
                    if similar(known, shingles(y.encode())):
                        u.append(a)
                        v.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    named = [texts.select(F.col("row").alias(k), F.col("text").alias(f"text_{k}")) for k in ("u", "v")]
    return map_arrow(pairs.join(named[0], "u").join(named[1], "v").select("u", "v", "text_u", "text_v"), run, "u long, v long")


def _leaders(held: DataFrame, turn: int) -> DataFrame:
    """``held`` beside its bucket's leader of this turn, ``other`` and ``other_part``."""
    order = F.xxhash64("row", F.lit(turn))
    return held.join(held.groupBy("bucket").agg(F.min_by("row", order).alias("other"), F.min_by("part", order).alias("other_part")), "bucket")


def shard_links(rows: list[int], parts: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """Links between similar rows of different parts, each only where the two are not joined yet."""
    sets = [np.fromiter((xxh64_intdigest(s) for s in shingles(t.encode())), np.uint64) for t in texts]
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    held, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for i, mine in enumerate(sets):
        first, last = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
        more = last - first > 1
        met = [owner[a:b] for a, b in zip(first[more].tolist(), last[more].tolist(), strict=True)]
        if not met:
            continue
        both = np.bincount(np.concatenate(met), minlength=len(sets))
        for j in np.flatnonzero(5 * both >= 4 * (sizes[i] + sizes - both)).tolist():
            x, y = find(parts[i]), find(parts[j])
            if j < i and x != y:
                root[max(x, y)] = min(x, y)
                out.append((rows[i], rows[j]))
    return out


def _settled(held: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) among all rows of each bucket. A bucket of more than ``BLOCK`` rows becomes a shard for each two blocks."""
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    dealt = held.join(held.groupBy("bucket").agg(blocks.alias("blocks")), "bucket").withColumn("mine", F.pmod(F.xxhash64("row"), "blocks"))
    k = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("bucket", "row", "part", "mine", k.alias("k")).select(F.xxhash64("bucket", F.least("mine", "k"), F.greatest("mine", "k")).alias("shard"), "row", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(now: list) -> pa.RecordBatch:
            found = shard_links(*map(list, zip(*now, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        shard, now = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if s != shard and now:
                    yield out(now)
                    now = []
                shard = s
                now.append(row)
        if now:
            yield out(now)

    ready = dealt.join(texts, "row").select("shard", "row", "part", "text").repartition("shard").sortWithinPartitions("shard")
    return map_arrow(ready, run, "u long, v long")


def _open(held: DataFrame) -> DataFrame:
    """The buckets that still hold more than one component."""
    many = held.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("bucket")
    return held.join(many, "bucket")


def first_rows(rows: DataFrame) -> DataFrame:
    """``row`` of one row for each group of near-duplicates: the smallest doc_id, nulls last, then the smallest row.

    ``rows`` has row (a different long for each), doc_id and text, and reads alike each time. What is written on the way is deleted.
    """
    with scratch(rows.sparkSession) as keep:
        return _first_rows(rows, keep)


def _first_rows(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    made = materialize(signatures(rows), "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    ranked = made.select("row", "digest").join(rows.select("row", "doc_id"), "row")
    nodes = materialize(ranked.groupBy("digest").agg(F.min(rank).alias("rank")).select("rank.row", "rank"), "nodes")
    keys = made.join(nodes.select("row"), "row", "left_semi")
    near = near_duplicates(rows.join(nodes.select("row"), "row", "left_semi").select(F.col("row").alias("doc_id"), "text"))
    held = keys.select("row", F.explode("keys").alias("bucket")).unionByName(near.select(F.col("doc_id").alias("row"), F.xxhash64("component_id").alias("bucket")))
    held = materialize(_open(held.withColumn("part", F.col("row"))), "buckets")
    texts = materialize(rows.join(held.select("row").distinct(), "row", "left_semi").select("row", F.coalesce("text", F.lit("")).alias("text")), "texts")
    links = stars = None
    for turn in range(TURNS + 1):
        if held.isEmpty():
            break
        if turn < TURNS:
            led = materialize(_leaders(held, turn), "leaders")
            pairs = led.where("part != other_part").select(F.greatest("row", "other").alias("u"), F.least("row", "other").alias("v")).distinct()
            found = materialize(verified(materialize(pairs, "pairs"), texts), "links")
        else:
            found = materialize(_settled(held, texts), "links")
        links = found if links is None else links.unionByName(found)
        stars = components(links)
        if turn < TURNS:  # a leader has met all of its bucket
            known = stars.select(F.col("u").alias("row"), F.col("v").alias("root"))
            held = led.where("row != other").join(known, "row", "left").select("row", "bucket", F.coalesce("root", "row").alias("part"))
            held = materialize(_open(held), "buckets")
    if stars is None:
        return keep(materialize(nodes.select("row"), "first"))
    joined = nodes.join(stars.select(F.col("u").alias("row"), F.col("v").alias("root")), "row", "left")
    return keep(materialize(joined.groupBy(F.coalesce("root", "row").alias("root")).agg(F.min("rank").alias("rank")).select("rank.row"), "first"))
