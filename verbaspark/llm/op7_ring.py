"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` places on a ring of 64-bit hashes; a document belongs to the shard of the next place
clockwise of its doc_id's hash. Loads are bounded to the mean: of n rows every shard takes n // shards, and the
first n % shards one more. Rows of an arc whose shard is full continue clockwise to the next place whose shard
has room, so counts are at most one apart, and only overflowing rows move.

The arcs' counts (one number for each virtual node, however many rows there are) come to the driver, which
settles how many rows of each arc go where; rows are then ranked within their arc. Spark alone does the rest. At most
shards x nodes arcs are ranked at once, more where arcs are divided.

An arc of far more rows than the mean, as where rows share a doc_id or have none, is ranked in pieces by the rows' numbers, so that no
task gets all of it; which of its rows go on to other shards then depends on their order in the table.

Rows: null text counts as no text; a null doc_id hashes like a value; very long texts are only measured and hashed; ties within an arc, by a
second hash, are ranked by doc_id, then by the text's checksum; rows that repeat lie in one arc, ranked
one after another; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from verbaspark.llm.tables import documents
from verbaspark.runtime import materialize

#: An arc is ranked in pieces where it has more than so many times the mean of all arcs.
FAR_MORE = 8


def n_cells(shards: int, nodes: int) -> int:
    """Ring positions are counted in cells of equal size, so that a table can hold each cell's arc: eight and more for each node."""
    return max(1 << 16, 1 << (8 * shards * nodes - 1).bit_length())


def ring(shards: int, nodes: int) -> tuple[list[int], list[int]]:
    """The cells where arcs end, ascending, and the shard of each."""
    size, places = n_cells(shards, nodes), {}
    for s in range(shards):
        for v in range(nodes):
            cell, turn = xxh64_intdigest(f"{s}:{v}") % size, 0
            while cell in places:
                turn += 1
                cell = xxh64_intdigest(f"{s}:{v}:{turn}") % size
            places[cell] = s
    cells = sorted(places)
    return cells, [places[c] for c in cells]


def settle(counts: list[int], owner: list[int], shards: int) -> list[list[tuple[int, int]]]:
    """For each arc, (shard, rows) in the order of the rows' ranks: its own shard first, then clockwise."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    left = [0] * len(counts)
    for a, n in enumerate(counts):
        take = min(n, room[owner[a]])
        room[owner[a]] -= take
        left[a] = n - take
        if take:
            out[a].append((owner[a], take))
    for a, n in enumerate(left):
        b = a
        while n:
            b = (b + 1) % len(counts)
            take = min(n, room[owner[b]])
            if take:
                room[owner[b]] -= take
                n -= take
                out[a].append((owner[b], take))
    return out


def assign(docs: DataFrame, shards: int = 24, nodes: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    spark = docs.sparkSession
    cells, owner = ring(shards, nodes)
    size = n_cells(shards, nodes)
    text = F.coalesce("text", F.lit(""))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    # The arc of a cell: a lookup in one table of all cells, whose size follows from shards and nodes alone.
    arc_of = np.searchsorted(cells, np.arange(size)) % len(cells)
    arcs = spark.createDataFrame(pa.table({"cell": np.arange(size, dtype=np.int32), "arc": arc_of.astype(np.int32)}))
    keyed = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell.cast("int").alias("cell"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(keyed.join(F.broadcast(arcs), "cell").drop("cell"), "rows")
    counts = [0] * len(cells)
    for r in rows.groupBy("arc").count().collect():  # at most one row for each virtual node
        counts[r["arc"]] = r["count"]
    most = max(1, FAR_MORE * sum(counts) // len(counts))
    split = [(a, -(-n // most)) for a, n in enumerate(counts) if n > most]  # fewer than one arc in FAR_MORE
    rows = rows.join(F.broadcast(spark.createDataFrame(split, "arc int, pieces int")), "arc", "left").withColumn("piece", F.coalesce(F.pmod("place", "pieces"), F.lit(0)).cast("int"))
    before = {}
    if split:
        have = {(r["arc"], r["piece"]): r["count"] for r in rows.where("pieces is not null").groupBy("arc", "piece").count().collect()}
        for a, pieces in split:
            before[a] = np.cumsum([0] + [have.get((a, k), 0) for k in range(pieces)]).tolist()
    table, filled = [], [0] * shards
    for a, parts in enumerate(settle(counts, owner, shards)):
        rank, starts = 0, before.get(a, [0, counts[a]])
        for s, n in parts:
            for k, (low, high) in enumerate(zip(starts, starts[1:], strict=False)):
                if low < rank + n and high > rank:
                    table.append((a, k, max(rank, low) - low, min(rank + n, high) - low, s, filled[s] - rank + low))
            rank += n
            filled[s] += n
    ranges = spark.createDataFrame(table, "arc int, piece int, low long, high long, shard int, shift long")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("arc", "piece").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_crc32")).cast("long") - 1)
    same = (ranked.arc == ranges.arc) & (ranked.piece == ranges.piece)
    found = ranked.join(F.broadcast(ranges), same & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))  # at most a few rows for each virtual node
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot"))


def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
