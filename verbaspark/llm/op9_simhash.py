"""SimHash near-duplicates by vantage-point trees over all distinct fingerprints.

Two fingerprints at most four bits apart are at most one bit apart in some quarter of the bits, so there are four trees,
one for each quarter. A tree's node has a vantage point and a distance, both taken where the two sides then cost least;
a fingerprint has its home on one side of the distance, within the quarter, and looks for partners on each side that
the triangle bound leaves open. Where a node's homes agree in the whole quarter, its children go on by the distance over
all bits. The upper levels of the trees are laid out over a bounded sample of fingerprints and cut all fingerprints
into shards: one row in the home's shard, and a copy in every other shard whose boundary the search overlaps. In
its shard's task every fingerprint searches the lower levels, and what is left at the leaves is compared bit by bit.

Copies of a text share one fingerprint and meet once. Where no distance parts a node's homes, as in a large group of near
copies, points are linked to vantage points until most are one component, and only pairs of different components are
compared. A shard that is still too large is dealt out as pairs of blocks. A task emits a spanning forest of its links.

Rows: null text counts as empty; a text without words has fingerprint zero and links like any other; very long texts are
read whole, in slices; rows that repeat and equal fingerprints get equal answers; a null doc_id counts only where its
component has no other; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from verbaspark.llm.components import components
from verbaspark.llm.encoding import flat_text
from verbaspark.llm.tables import chunks, documents, id_and_text, map_arrow
from verbaspark.runtime import materialize

RADIUS = 4
#: Each tree's part of the bits, and how far apart two linked fingerprints lie at most in one of the parts.
QUARTERS, NEAR = [np.uint64(0xFFFF << (16 * k)) for k in range(4)], RADIUS // 4
WHOLE = np.uint64(2**64 - 1)
#: Homes in a leaf, homes that a shard should have, and homes or searches in a block of a shard that has far more.
LEAF, SHARD, BLOCK = 64, 8192, 1 << 16
#: Fingerprints that the upper levels are laid out over, at most, and at most a sixteenth of all; and homes of the sample in a shard, at least.
SAMPLE, LEAST = 1 << 16, 32
#: A fingerprint with more than this part of the documents is one of few.
PARTS = 1024
#: A node is split where that leaves less than this part of its pairs of homes and searches.
GAIN = 0.9


def fingerprint(text: bytes, size: int = 4) -> int:
    """SimHash of the ``size``-word shingles of a UTF-8 text."""
    words = text.lower().split()  # of bytes: only A-Z change, and only 0x20 and 0x09-0x0D divide
    if not words:
        return 0
    joined = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    starts = ends - n
    k = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    h = np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)], np.uint64, k)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, k, 255), axis=0)  # eight counters of a byte in each word
    counts = sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, sizes = flat_text(batch.column(1))
            ends = np.cumsum(sizes).tolist()
            fp = np.array([fingerprint(data[e - n : e], size) for e, n in zip(ends, sizes.tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(id_and_text(docs), run, "doc_id long, fp long")


class Links:
    """Union-find over the rows of one shard, for whole arrays of pairs; a parent is never above its child."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while (root != (up := self.parent[root])).any():
            root = up
        return root

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.parent, a, b)


class Split(NamedTuple):
    """A node's vantage point, the bits that its distances count, its distance, and how far apart partners may lie."""

    vantage: np.uint64
    bits: np.uint64
    middle: int
    slack: int

    def sides(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Is the home inside; does the triangle bound leave the inside open; and the outside."""
        d = np.bitwise_count((fp ^ self.vantage) & self.bits).astype(np.int64)
        return d <= self.middle, d <= self.middle + self.slack, d > self.middle - self.slack


def best_split(homes: np.ndarray, searches: np.ndarray, bits: np.uint64) -> Split | None:
    """The distance from a home in the middle that leaves the fewest pairs; none where it leaves most of them.

    Where the homes agree in a quarter, the split is by all bits."""
    vantage = homes[len(homes) // 2]
    for part in (bits, WHOLE):
        slack = RADIUS if part == WHOLE else NEAR
        near, far = (np.cumsum(np.bincount(np.bitwise_count((x ^ vantage) & part), minlength=65 + slack)) for x in (homes, searches))
        at = np.arange(64)
        below = np.append(np.zeros(slack, np.int64), far)[at]
        left = near[at] * far[at + slack] + (near[-1] - near[at]) * (far[-1] - below)
        middle = int(np.argmin(left))
        if left[middle] < GAIN * len(homes) * len(searches):
            return Split(vantage, part, middle, slack)
        if part == WHOLE:
            break
    return None


def _compare(fp: np.ndarray, homes: np.ndarray, searches: np.ndarray, links: Links) -> None:
    for a in range(0, len(homes), LEAF):
        part = homes[a : a + LEAF]
        for q in range(0, len(searches), 8192):
            some = searches[q : q + 8192]
            row, col = np.nonzero(np.bitwise_count(fp[some, None] ^ fp[part]) <= RADIUS)
            u, v = some[row], part[col]
            other = u != v
            links.add(u[other], v[other])


def _compare_dense(fp: np.ndarray, homes: np.ndarray, searches: np.ndarray, links: Links) -> int:
    """Links all within the radius of some homes to them; then compares only pairs of different components.

    Returns the number of pairs compared."""
    done = 0
    for turn in range(64):
        root = links.find(homes)
        names, n = np.unique(root, return_counts=True)
        rest = homes[root != names[n.argmax()]]
        if not len(rest) or turn and len(names) == before:
            break
        before = len(names)
        vantage = homes[len(homes) // 2] if not turn else rest[len(rest) // 2]
        for group in (homes, searches):
            links.add(near := group[np.bitwise_count(fp[group] ^ fp[vantage]) <= RADIUS], np.full(len(near), vantage))
            done += len(group)
    main = links.find(homes[root == names[n.argmax()]][:1])
    mine, theirs = links.find(homes) == main, links.find(searches) == main
    for h, s in ((homes[~mine], searches), (homes[mine], searches[~theirs])):
        _compare(fp, h, s, links)
        done += len(h) * len(s)
    return done


def search(fp: np.ndarray, homes: np.ndarray, searches: np.ndarray, links: Links, bits: np.uint64) -> dict[str, int]:
    """Link all pairs of a home and a search within the radius; both are row numbers into ``fp``.

    Returns how many nodes were split, how many branches the bound closed to all searches or to some, and pairs compared."""
    count = {"splits": 0, "pruned": 0, "pairs": 0}
    work = [(homes, searches, bits)]
    while work:
        homes, searches, bits = work.pop()
        if not len(homes) or not len(searches):
            continue
        split = best_split(fp[homes], fp[searches], bits) if len(homes) > LEAF else None
        if split is not None:
            inside = split.sides(fp[homes])[0]
            _, low, high = split.sides(fp[searches])
            work += [(homes[inside], searches[low], split.bits), (homes[~inside], searches[high], split.bits)]
            count["splits"] += 1
            count["pruned"] += 2 * len(searches) - int(low.sum()) - int(high.sum())
        elif len(homes) > LEAF:
            count["pairs"] += _compare_dense(fp, homes, searches, links)
        else:
            _compare(fp, homes, searches, links)
            count["pairs"] += len(homes) * len(searches)
    return count


def shard_links(fp: np.ndarray, home: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one shard: pairs of fingerprints."""
    fp = fp.view(np.uint64)
    order = np.lexsort((~home, fp))
    fp, home = fp[order], home[order]
    links = Links(len(fp))
    search(fp, np.flatnonzero(home), np.arange(len(fp)), links, bits)
    root = links.find(np.arange(len(fp)))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, tree, fp, home) come ordered by shard; a shard may run over several batches."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.append(np.flatnonzero(np.diff(cols[0], prepend=cols[0][:1] - 1)), len(cols[0]))
        found = [shard_links(cols[2][a:b], cols[3][a:b], QUARTERS[cols[1][a]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]
        if found:
            u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if not len(new[0]):
            continue
        cols = [np.concatenate([a, b]) for a, b in zip(rest, new, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        yield from out([c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if len(rest[0]):
        yield from out(rest)


#: A tree's upper levels: a node's split with its two children, or a shard's number.
Tree = tuple | int


def lay_out(sample: np.ndarray, bits: np.uint64, least: int, first: int) -> tuple[Tree, int]:
    """The upper levels over a sample, with at least ``least`` of it in a node that is split, and the number after the last shard's."""
    split = best_split(sample, sample, bits) if len(sample) > least else None
    if split is None:
        return first, first + 1
    inside = split.sides(sample)[0]
    left, first = lay_out(sample[inside], split.bits, least, first)
    right, first = lay_out(sample[~inside], split.bits, least, first)
    return (split, left, right), first


def descend(tree: Tree, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard with the fingerprints that search it, and which of them have their home there."""
    work = [(tree, fp, np.ones(len(fp), bool))]
    while work:
        node, mine, home = work.pop()
        if not len(mine):
            continue
        if isinstance(node, int):
            yield node, mine, home
            continue
        inside, low, high = node[0].sides(mine)
        work += [(node[1], mine[low], (home & inside)[low]), (node[2], mine[high], (home & ~inside)[high])]


def shards(nodes: DataFrame) -> DataFrame:
    """shard, tree, fp and home: each fingerprint's row at home and its copies in the shards that it searches."""
    total = nodes.count()
    rows = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(max(total, 16 * SAMPLE))) < SAMPLE) if total > SHARD else nodes.limit(0)
    sample = np.array([r.fp for r in rows.collect()], np.int64).view(np.uint64)  # about SAMPLE at most
    least, first, trees = max(LEAST, SHARD * len(sample) // max(total, 1)), 0, []
    for bits in QUARTERS:
        tree, first = lay_out(np.sort(sample), bits, least, first)
        trees.append(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                for shard, mine, home in descend(tree, fp):
                    n = len(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, k, np.int32)), pa.array(mine.view(np.int64)), pa.array(home)], ["shard", "tree", "fp", "home"])

    return map_arrow(nodes.select("fp"), run, "shard long, tree int, fp long, home boolean")


def links(nodes: DataFrame) -> DataFrame:
    """A forest of links (u, v) that joins all fingerprints ``fp`` within the radius of one another."""
    rows = materialize(shards(nodes), "shards")
    # One row for each shard far above its size, of the SAMPLE / LEAST that a tree has at most.
    size = rows.groupBy("shard").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("b"), F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("c")).where("b > 1 or c > 1")
    placed = rows.join(F.broadcast(size), "shard", "left").withColumns({"b": F.coalesce("b", F.lit(1)), "c": F.coalesce("c", F.lit(1))})
    # A fingerprint is a home in its row of cells (i, j), and searches in its column.
    i, j = F.pmod(F.xxhash64("fp"), "b"), F.pmod(F.xxhash64("fp", F.lit(1)), "c")
    cell = lambda i, j, home: F.struct((F.col("shard") * 2**32 + i * 2**16 + j).alias("shard"), F.lit(home).alias("home"))
    row = F.transform(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda _: F.col("home")), lambda y: cell(i, y, True))
    column = F.transform(F.filter(F.sequence(F.lit(0), F.col("b") - 1), lambda x: ~F.col("home") | (x != i)), lambda x: cell(x, j, False))
    dealt = placed.select("tree", "fp", F.explode(F.concat(row, column)).alias("cell")).select("cell.shard", "tree", "fp", "cell.home")
    return map_arrow(dealt.repartition("shard").sortWithinPartitions("shard"), _search_shards, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most ``RADIUS`` bits reach."""
    fps = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    stars = components(links(nodes))
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = member.join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.join(least, "root").select("fp", "component_id")
    of = nodes.join(known, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    # Fingerprints of more than a part of all documents are fewer than PARTS: they are met by a broadcast, so that no task gets all copies of a text.
    often = F.col("n") * PARTS > (nodes.agg(F.sum("n")).first()[0] or 0)
    many = F.broadcast(of.where(often).drop("n"))
    copies = fps.join(many, "fp")
    others = fps.join(many.select("fp"), "fp", "left_anti").join(of.where(~often).drop("n"), "fp")
    return copies.unionByName(others).select("doc_id", "fp", "component_id")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
