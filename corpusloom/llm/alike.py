"""Near copies by shared wording: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Such texts mostly differ in more fingerprint bits than SimHash links. Candidates are documents that agree on a band of
MinHash values; every candidate pair that no link joins yet is then compared shingle by shingle, so no false pair links.
A pair at the threshold shares one band at least with a chance of 1 - (1 - 0.8^4)^20, that is all but 3 in 100,000, and
more alike pairs are missed less often. No shingle, document or band is left out, however common.

Documents of one shingle set or one fingerprint are linked without a comparison. Then rounds follow in which all that a
band holds outside its largest component is compared with one document of that component, as long as a round links
anything: a group of n near copies falls into one component after about log n rounds of fewer than n pairs for each band.
What bands still hold of different components after that is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import FEW_SALTS, discard, every_salt, salt_of, saved, spare, spread_join
from corpusloom.llm.components import components
from corpusloom.llm.simhash import SEED, near_links, shingle_hashes, simhash

SHINGLE_WORDS = 5
# Least similarity, as a fraction: whole numbers decide, without rounding.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
_MIXERS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_MIXERS[1] |= np.uint64(1)
MEMBER = ["node", "digest", "size", "component"]


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def bands(shingles: np.ndarray) -> list[int]:
    """A hash for each band of MinHash values; none for a text without words. Blocks bound the memory of long texts."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        mixed = (shingles[at : at + 1024, None] ^ _MIXERS[0]) * _MIXERS[1]
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - 2**63 for band, row in enumerate(least.reshape(BANDS, ROWS))]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def _digest(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - 2**63


def _sketches(rows: DataFrame) -> DataFrame:
    """From doc_id, text_hash, text, in one pass: doc_id, text_hash, fp (fingerprint), digest and size of the shingle set, bands."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or b"" for text in batch.column(2).to_pylist()]
            prints = [simhash(shingle_hashes(text)) for text in texts]
            sets = [shingle_set(text) for text in texts]
            columns = [
                *batch.columns[:2], pa.array(prints, pa.int64()), pa.array(map(_digest, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
                pa.array(map(bands, sets), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "digest", "size", "bands"])

    return rows.mapInArrow(sketched, "doc_id long, text_hash long, fp long, digest long, size long, bands array<long>")


def _salted_join(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join slim rows (node) with the one slim row of their key. Salts that are the same for all keys take two shuffles,
    where `spread_join` takes four."""
    salted = rows.withColumn("salt", salt_of(F.col("node"), salts=FEW_SALTS))
    return salted.join(every_salt(groups), [key, "salt"], how).drop("salt")


def _known_links(nodes: DataFrame) -> DataFrame:
    """Links a, b of nodes (node, fp, digest, size) that need no comparison: one shingle set, or fingerprints within three bits."""
    nodes = nodes.select("node", "fp", "digest", "size")
    by_set = nodes.where("size > 0").groupBy("digest").agg(F.min("node").alias("b"))
    by_print = saved(nodes.groupBy("fp").agg(F.min("node").alias("b")), "prints")
    same_set = _salted_join(nodes, by_set, "digest").select(F.col("node").alias("a"), "b")
    same_print = _salted_join(nodes, by_print, "fp").select(F.col("node").alias("a"), "b")
    near = near_links(by_print).withColumnsRenamed({"a": "fp", "b": "other"}).join(by_print.withColumnRenamed("b", "a"), "fp")
    near = near.join(by_print.withColumnRenamed("fp", "other"), "other").select("a", "b")
    return saved(same_set.union(same_print).union(near).where("a <> b").distinct(), "known-links")


def _divided(members: DataFrame, turn: int) -> DataFrame:
    """The rows (key, MEMBER) of the keys that more than one component has, each with its key's leader (a struct of MEMBER):
    one of the largest component."""
    order = F.xxhash64("node", F.lit(turn))  # the same document leads in many keys, so that pairs repeat and are compared once
    first = F.min(F.struct(order.alias("at"), *MEMBER))
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), first.alias("x"))
    largest = F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("first")
    keys = parts.groupBy("key").agg(largest, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    leaders = keys.select("key", F.struct(*(F.col(f"first.x.{c}").alias(c) for c in MEMBER)).alias("leader"))
    return _salted_join(members, leaders, "key").select("key", *MEMBER, "leader")


def _all_pairs(members: DataFrame) -> DataFrame:
    a = members.select("key", F.struct(*MEMBER).alias("a"))
    return a.join(a.withColumnRenamed("a", "b"), "key").where("a.component < b.component").select("a", "b")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """From structs a, b (MEMBER): the components a, b of the pairs that are alike, saved."""
    least, most = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    apart = pairs.where("a.component <> b.component").where(least * LEAST[1] >= most * LEAST[0])
    asked = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(
        *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in MEMBER)
    )
    asked = saved(asked, "asked")
    side = lambda name: texts.select(*(F.col(c).alias(f"{name}_{c}") for c in ("node", "digest", "text")))
    with_a = spread_join(asked, side("a"), ["a_node", "a_digest"], "b_node")
    with_b = spread_join(with_a, side("b"), ["b_node", "b_digest"], "a_node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = lru_cache(64)(shingle_set)  # the document that many are compared with is cut once
        for batch in batches:
            found = [alike(shingles(x), shingles(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    compared = with_b.select("a_component", "b_component", "a_text", "b_text").mapInArrow(compare, "a long, b long")
    found = saved(compared.distinct(), "found-links")
    discard(asked)
    return found


def _nearest_roots(links: DataFrame) -> DataFrame:
    """node, root: the smallest node within two links, which is the same for all that link with one document.

    Enough between rounds, where a component that is still in parts only costs comparisons.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both.withColumn("salt", salt_of(F.col("a"), salts=FEW_SALTS)), "links")
    one = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    two = both.join(every_salt(one.select(F.col("a").alias("b"), "root")), ["b", "salt"]).groupBy("a").agg(F.min("root").alias("root"))
    return two.select(F.col("a").alias("node"), F.least("a", "root").alias("root"))


def _joined(table: DataFrame, roots: DataFrame) -> DataFrame:
    """The table with the roots of its components, which may hold any number of its rows."""
    named = roots.select(F.col("node").alias("component"), "root")
    known = _salted_join(table, named, "component", "left")
    return known.withColumn("component", F.coalesce("root", "component")).drop("root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with an id: doc_id, component (smallest id reachable).

    Links are those of SimHash (three bits) and of shared wording. Texts of fewer than five words are alike if equal
    without regard to A-Z case and white space. Texts without words link by SimHash only. An id's rows are one document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.where("doc_id is not null")
    sketched = saved(_sketches(rows), "sketches")
    # Documents of one fingerprint and one shingle set are one node, named by the smallest id.
    first = F.min(F.struct("doc_id", "text_hash")).alias("x")
    classes = sketched.groupBy("fp", "digest").agg(first, F.min("size").alias("size"), F.min("bands").alias("bands"))
    classes = saved(classes.select("fp", "digest", F.col("x.doc_id").alias("node"), F.col("x.text_hash").alias("text_hash"), "size", "bands"), "nodes")
    roots = components(_known_links(classes))
    sets = classes.groupBy("digest").agg(F.min(F.struct("node", "text_hash", "size", "bands")).alias("x")).select("digest", "x.*")
    sets = saved(_joined(sets.withColumn("component", F.col("node")), roots), "sets")
    left = saved(_divided(sets.select(F.explode("bands").alias("key"), *MEMBER), 0), "band-members")
    asked = left.select("node", "digest").distinct().join(sets.select("node", "digest", "text_hash"), ["node", "digest"])
    asked = asked.withColumnRenamed("node", "doc_id")
    texts = rows.join(asked, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "digest"])
    texts = saved(texts.select(F.col("doc_id").alias("node"), "digest", "text"), "asked-texts")
    links, turn = [], 0
    while not left.isEmpty():
        found = _links(left.select(F.struct(*MEMBER).alias("a"), F.col("leader").alias("b")), texts)
        if found.isEmpty():
            break
        links.append(found)
        turn += 1
        # Saved, as two shuffles read it.
        before, moved = left, saved(_joined(left.drop("leader"), _nearest_roots(found)), "moved-members")
        left = saved(_divided(moved, turn), "band-members")
        discard(before, moved)
    if not left.isEmpty():
        links.append(_links(_all_pairs(left), texts))
    merged = reduce(DataFrame.union, [roots.select(F.col("node").alias("a"), F.col("root").alias("b")), *links])
    final = components(merged)
    named = _joined(classes.select("fp", "digest", "node", F.col("node").alias("component")), final).select("fp", "digest", "component")
    out = saved(spread_join(sketched.select("doc_id", "fp", "digest"), named, ["fp", "digest"], "doc_id").groupBy("doc_id").agg(F.min("component").alias("component")), "copies")
    discard(sketched, classes, sets, texts, left, *links)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each component keeps the one with the smallest id; all columns stay as they are.

    Rows that repeat an id stay or go together; rows without an id stay.
    """
    gone = spare("gone", docs)
    found = near_copies(docs, id_col, text_col).where("doc_id <> component").select(F.col("doc_id").alias(gone))
    return docs.join(found, F.col(id_col) == F.col(gone), "left_anti")
