"""SimHash near-duplicates, found exactly with vantage-point trees.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of their left or of their right half.
For each half a vantage-point tree partitions all distinct fingerprints by the Hamming distance of that half: a node
sends distances up to its median to its near child and larger ones to its far child. By the triangle inequality two
halves one bit apart have distances to the vantage point that differ by at most one, so the near child also gets the
single layer just beyond the median (the boundary overlap), and every such pair shares a leaf. Each leaf is a shard;
a task links the pairs of a shard by comparing all 64 bits, and splits a large shard by further vantage points first.

The trees are fitted on a bounded sample that Spark draws; all fingerprints are routed through them. Leaves hand on a
spanning forest of their links, not all pairs, and links are joined to components in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import salt_mask, salt_of, salts_in, saved, spare, spread_join
from corpusloom.llm.components import components

BITS = 64
MAX_BITS = 3
SHINGLE_WORDS = 3
SEED = 42
# Distinct fingerprints that the trees are fitted on, whatever the size of the table; and when a node stops to split.
TREE_SAMPLE = 16_384
LEAF_SAMPLE = 4
# A shard is compared pair by pair up to this size, and split by further vantage points beyond it.
BLOCK = 512
LOW = np.uint64(0xFFFFFFFF)


# ---- fingerprints


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles, repeats included. bytes.lower and bytes.split know exactly A-Z and ASCII white space."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(found) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes. No hashes: zero. Blocks bound the memory of long texts."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = np.ascontiguousarray(hashes[at : at + 65_536].astype("<u8"))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long). A null text counts as empty: zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(shingle_hashes(text or b"")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


# ---- vantage-point trees


@dataclass
class Tree:
    """A vantage-point tree over one half of the bits, as arrays: node i has a vantage point and a median distance."""

    shift: int
    vantage: list[int]
    median: list[int]
    near: list[int]  # a node, or ~leaf
    far: list[int]
    leaves: int

    def half(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.shift)) & LOW

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (row, leaf) pairs: every leaf that may hold a half within one bit of a row's half."""
        half, rows, leaves = self.half(fps), [], []
        stack = [(0 if self.vantage else ~0, np.arange(len(fps)))]
        while stack:
            node, members = stack.pop()
            if not len(members):
                continue
            if node < 0:
                rows.append(members)
                leaves.append(np.full(len(members), ~node, np.int32))
                continue
            distance = np.bitwise_count(half[members] ^ np.uint64(self.vantage[node]))
            stack.append((self.near[node], members[distance <= self.median[node] + 1]))
            stack.append((self.far[node], members[distance > self.median[node]]))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate(rows), np.concatenate(leaves)


def _split(half: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and a median distance that leave as few rows as possible in the larger child; None if none helps."""
    best = None
    for at in {0, len(half) // 3, len(half) // 2, 2 * len(half) // 3, len(half) - 1}:
        counts = np.bincount(np.bitwise_count(half ^ half[at]), minlength=34)
        below = np.cumsum(counts)
        larger = np.maximum(below[1:33], len(half) - below[:32])  # the near child holds one layer more than the median
        cut = int(np.argmin(larger))
        if best is None or larger[cut] < best[0]:
            best = (int(larger[cut]), int(half[at]), cut)
    return None if best[0] > 0.9 * len(half) else best[1:]


def fit_tree(sample: np.ndarray, shift: int, leaf: int = LEAF_SAMPLE) -> Tree:
    tree = Tree(shift, [], [], [], [], 0)
    todo = [(tree.half(sample), None)]
    while todo:
        half, parent = todo.pop()
        found = _split(half) if len(half) > leaf else None
        name = ~tree.leaves if found is None else len(tree.vantage)
        if parent is not None:
            parent[0][parent[1]] = name
        if found is None:
            tree.leaves += 1
            continue
        tree.vantage.append(found[0])
        tree.median.append(found[1])
        tree.near.append(0)
        tree.far.append(0)
        distance = np.bitwise_count(half ^ np.uint64(found[0]))
        todo.append((half[distance <= found[1] + 1], (tree.near, name)))
        todo.append((half[distance > found[1]], (tree.far, name)))
    return tree


# ---- links within a shard


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is within max_bits, found breadth first: what is reached is not compared again."""
    links, rest = [], np.arange(len(fps))
    if 1 < len(fps) <= BLOCK:  # most shards are small and hold no link, which one comparison of all shows
        near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits).sum(axis=1) > 1
        rest = np.flatnonzero(near)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        root = int(front[0])
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                left = np.flatnonzero(~reached)
                close = np.bitwise_count(fps[front[at : at + 64], None] ^ fps[None, rest[left]]) <= max_bits
                reached[left[close.any(axis=0)]] = True
            front, rest = rest[reached], rest[~reached]
            links += [(root, int(x)) for x in front]
    return links


def shard_links(fps: np.ndarray, shift: int, max_bits: int = MAX_BITS, block: int = BLOCK) -> list[tuple[int, int]]:
    """Index pairs that connect a shard's fingerprints within max_bits; large shards go down a tree of their own."""
    links, stack = [], [np.arange(len(fps))]
    half = (fps >> np.uint64(shift)) & LOW
    while stack:
        members = stack.pop()
        found = _split(half[members]) if len(members) > block else None
        if found is None:
            links += [(int(members[a]), int(members[b])) for a, b in _forest(fps[members], max_bits)]
            continue
        distance = np.bitwise_count(half[members] ^ np.uint64(found[0]))
        stack += [members[distance <= found[1] + 1], members[distance > found[1]]]
    return links


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, sample: int = TREE_SAMPLE) -> DataFrame:
    """From distinct fingerprints (fp): pairs a, b that connect all fingerprints within max_bits of each other."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves find pairs of up to three differing bits")
    drawn = distinct.select("fp").orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(sample)
    fitted = np.array([row.fp for row in drawn.collect()], np.int64).view(np.uint64)
    trees = [fit_tree(fitted, shift) for shift in (0, 32)]
    shared = distinct.sparkSession.sparkContext.broadcast(trees)  # at most a few nodes for each sampled fingerprint

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for number, tree in enumerate(shared.value):
                rows, leaves = tree.route(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves.astype(np.int64) * 2 + number), pa.array(fps[rows])], ["shard", "fp"]
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fps in _shards(batches):
            pairs = np.array(shard_links(fps.view(np.uint64), 32 * (shard % 2), max_bits), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, 0]]), pa.array(fps[pairs[:, 1]])], ["a", "b"])

    routed = distinct.select("fp").mapInArrow(route, "shard long, fp long")
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(link, "a long, b long")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The shards of a sorted partition, one at a time; a shard may span batches, and most batches hold many."""
    open_shard, parts = None, []
    for batch in batches:
        shards, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            shard = int(shards[start])
            if parts and shard != open_shard:
                yield open_shard, np.concatenate(parts)
                parts = []
            open_shard = shard
            parts.append(fps[start:end])
    if parts:
        yield open_shard, np.concatenate(parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null, empty and blank texts have fingerprint zero and link like others. Rows with the same id are rows of their own
    with the same result if their texts agree. A null id never is the smallest one unless its component has no other.
    An empty table gives no rows. Other columns of the input are ignored.
    """
    marked = saved(fingerprints(docs, id_col, text_col), "fingerprints").withColumn("salt", salt_of(F.col("doc_id")))
    distinct = saved(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), salt_mask("salt").alias("mask")), "distinct-fingerprints"
    )
    roots = components(near_links(distinct, max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = spread_join(rooted, smallest, ["root"], "fp").select("fp", "component_id", salts_in("mask").alias("salt"))
    return marked.join(classes, ["fp", "salt"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents of which each component keeps the one with the smallest id; all columns stay as they are.

    Rows that repeat an id stay or go together; rows without an id stay.
    """
    gone = spare("gone", docs)
    found = near_duplicates(docs, id_col, text_col, max_bits).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(id_col) == F.col(gone), "left_anti")
