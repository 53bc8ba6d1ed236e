"""Ranked lexical search with FP-trees of documents.

Documents are cut down to the terms that the items ask for, and the terms of each are put in order of frequency, the
most frequent first, so that documents share paths of a trie. The trie is path-compressed: a node is a range of the
documents sorted by their paths. Every node knows, for each term below it, the largest tf and the smallest m of its
subtree; as a term's share of a score grows with tf and falls with m, these bound every score below the node. For each
item a depth-first search takes the child of the largest bound first and leaves out subtrees that can't reach the item's
tenth best score so far.

A task builds one tree at a time of a bounded number of documents and carries its best scores from tree to tree. What
the corpus gives to the weights (documents, terms, document frequencies) is counted by Spark over all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import salt_of, saved

TOP = 10
# Documents of a tree; subtrees of so many documents are scored one by one.
TREE_DOCS, LEAF_DOCS = 8_192, 24
# Items are searched in blocks of so many (item, term) pairs at most (or one item); a block is sent to all tasks.
BLOCK_TERMS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A byte of a term as it is, A-Z in lower case; any other byte as a space. Bytes from 0x80 on belong to terms.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return text.translate(_TABLE).split(b" ")


def term_counts(text: bytes) -> Counter:
    counts = Counter(terms(text))
    del counts[b""]
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight, in whole numbers; grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# ---- the tree


@dataclass
class Tree:
    """A path-compressed FP-tree: node i covers the documents low[i] to high[i] (in path order); its children are a range of nodes."""

    low: list[int]
    high: list[int]
    first_child: list[int]  # 0 for a leaf
    n_children: list[int]
    least_id: list[int]
    # The terms below nodes, by rank: of each rank the nodes and the share for its largest tf and their smallest m.
    starts: np.ndarray
    nodes: np.ndarray
    most: np.ndarray
    # The documents' terms, by document.
    ends: list[int]
    doc_of: np.ndarray
    ranks: np.ndarray
    shares: np.ndarray
    doc_id: np.ndarray

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node what no score below it exceeds."""
        out = np.zeros(len(self.low), np.int64)
        if len(ranks):
            spans = [slice(a, b) for a, b in zip(self.starts[ranks].tolist(), self.starts[ranks + 1].tolist())]
            worth = np.concatenate([self.most[x] * w for x, w in zip(spans, weights.tolist())])
            np.add.at(out, np.concatenate([self.nodes[x] for x in spans]), worth)
        return out

    def scores(self, node: int, weight_of: np.ndarray) -> np.ndarray:
        """The scores of a node's documents, from the weights of all ranks (0 where the item has not the term)."""
        low = self.low[node]
        a, b = self.ends[low], self.ends[self.high[node]]
        out = np.zeros(self.high[node] - low, np.int64)
        np.add.at(out, self.doc_of[a:b] - low, weight_of[self.ranks[a:b]] * self.shares[a:b])
        return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def build(ids: list[int], m: np.ndarray, paths: list[np.ndarray], tfs: list[np.ndarray], width: int, leaf: int = LEAF_DOCS) -> Tree:
    """From documents with ascending term ranks (rank 0: the most frequent term) and the tf of each."""
    order = sorted(range(len(ids)), key=lambda i: (paths[i].astype(">u4").tobytes(), ids[i]))
    paths, tfs = [paths[i] for i in order], [tfs[i] for i in order]
    doc_id, m = np.array([ids[i] for i in order], np.int64), m[order]
    common = np.array([0] + [_shared(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    low, high, first, count = [0], [len(ids)], [0], [0]
    at = 0
    while at < len(low):  # breadth first: the children of a node are neighbours
        a, b = low[at], high[at]
        if b - a > leaf:
            inner = common[a + 1 : b]
            edges = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
            starts = [edges[0]]
            for start, end in zip(edges[1:], edges[2:]):  # small neighbours share a leaf
                if end - starts[-1] > leaf:
                    starts.append(start)
            if len(starts) == 1:  # nothing but the last branch is left to cut off
                starts.append(edges[-2])
            first[at], count[at] = len(low), len(starts)
            low += starts
            high += [*starts[1:], b]
            first += [0] * len(starts)
            count += [0] * len(starts)
        at += 1
    sizes = np.array([len(p) for p in paths], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    ranks, tf = np.concatenate(paths).astype(np.int64), np.concatenate(tfs).astype(np.int64)
    below: list[tuple[np.ndarray, np.ndarray]] = [(ranks[:0], tf[:0])] * len(low)
    most = np.zeros(width, np.int64)
    for node in range(len(low) - 1, -1, -1):
        if count[node]:
            parts = below[first[node] : first[node] + count[node]]
            found, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        else:
            span = slice(ends[low[node]], ends[high[node]])
            found, values = ranks[span], tf[span]
        np.maximum.at(most, found, values)
        found = np.unique(found)
        below[node] = (found, most[found])
        most[found] = 0
    least_m = np.array([m[a:b].min() for a, b in zip(low, high)], np.int64)
    nodes = np.repeat(np.arange(len(low)), [len(found) for found, _ in below])
    under, largest = np.concatenate([found for found, _ in below]), np.concatenate([values for _, values in below])
    by_rank = np.argsort(under, kind="stable")
    doc_of = np.repeat(np.arange(len(ids)), sizes)
    return Tree(
        low, high, first, count, [int(doc_id[a:b].min()) for a, b in zip(low, high)],
        np.searchsorted(under[by_rank], np.arange(width + 1)), nodes[by_rank], share(largest, least_m[nodes])[by_rank],
        ends.tolist(), doc_of, ranks, share(tf, m[doc_of]), doc_id,
    )


def search(tree: Tree, ranks: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: list[tuple[int, int]], top: int = TOP) -> int:
    """Put the tree's documents into `best`, a heap of (score, -doc_id), by branch and bound; returns the documents scored.

    `weight_of` is a scratch array with a zero for each rank; it is left as it was.
    """
    scored, bounds = 0, tree.bounds(ranks, weights).tolist()
    weight_of[ranks] = weights
    stack = [0]
    while stack:
        node = stack.pop()
        if not bounds[node] or len(best) == top and (bounds[node], -tree.least_id[node]) <= best[0]:
            continue
        if tree.n_children[node]:
            first = tree.first_child[node]
            stack += sorted(range(first, first + tree.n_children[node]), key=bounds.__getitem__)
            continue
        found = tree.scores(node, weight_of)
        scored += len(found)
        least = best[0][0] if len(best) == top else 1
        for at in np.flatnonzero(found >= least).tolist():
            hit = (int(found[at]), -int(tree.doc_id[tree.low[node] + at]))
            if len(best) < top:
                heapq.heappush(best, hit)
            elif hit > best[0]:
                heapq.heapreplace(best, hit)
    weight_of[ranks] = 0
    return scored


# ---- the operator


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a struct with the item's id) and its distinct terms; rows that share an id are one item."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    rows = items.select(F.struct(F.col(id_col).alias("id")).alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.distinct().groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, list[str]]]]:
    """The items in blocks of a bounded number of terms; the driver holds one block."""
    block, size = [], 0
    for row in items.orderBy("item").toLocalIterator():
        if block and size + len(row.terms) > most:
            yield block
            block, size = [], 0
        block.append((row.item.id, row.terms))
        size += len(row.terms)
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (all terms), terms (numbers in the vocabulary) and tfs, of the documents with at least one term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one block of items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            ids, lengths, found, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = term_counts(text or b"")
                if counts:
                    known = [(number[t], c) for t, c in counts.items() if t in number]
                    ids.append(doc)
                    lengths.append(counts.total())
                    found.append([t for t, _ in known])
                    tfs.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _hits(rows: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], rank_of: np.ndarray, total: int, length: int, top: int, tree_docs: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the best of each task."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, rank_of))  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ranks_by_term = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        ids, sizes, paths, tfs = [], [], [], []
        weight_of = np.zeros(len(ranks_by_term), np.int64)

        def settle() -> None:
            m = 100 - 90 + (90 * np.array(sizes, np.int64) * total) // length
            tree = build(ids, m, paths, tfs, len(ranks_by_term))
            for (ranks, weights), heap in zip(items, best):
                search(tree, ranks, weights, weight_of, heap, top)
            for column in (ids, sizes, paths, tfs):
                column.clear()

        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            offsets, numbers, values = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ranks = ranks_by_term[numbers[offsets[i] : offsets[i + 1]]]
                order = np.argsort(ranks)
                ids.append(doc)
                sizes.append(n)
                paths.append(ranks[order])
                tfs.append(values[offsets[i] : offsets[i + 1]][order])
                if len(ids) == tree_docs:
                    settle()
        if ids:
            settle()
        out = [(item, -doc, score) for item, heap in enumerate(best) for score, doc in heap]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    # Documents without an id or an asked term can't be in a result.
    return rows.where("doc_id is not null and size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def _ranked(hits: DataFrame, keys: list[str | Column], top: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def ranked_search(
    items: DataFrame, docs: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text",
    top: int = TOP, block_terms: int = BLOCK_TERMS, tree_docs: int = TREE_DOCS,
) -> DataFrame:
    """One row for each of an item's best documents: item_id, rank (from 1), doc_id, score.

    Scores are above 0 and fall with the rank; of equal ones the smaller doc_id comes first. Null texts have no terms,
    an item without terms has no rows, and rows that share an item's id are one item with the terms of all. Documents
    that repeat an id are ranked each. A document without an id counts in the statistics but has no rank. Empty tables
    give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    out = None
    for block in _blocks(saved(item_terms(items, item_col, text_col), "item-terms"), block_terms):
        vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        rows = saved(vectors(docs, vocabulary, id_col, text_col), "term-vectors")
        head = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not head.docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for row in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            df[row.term] = row["count"]
        by_frequency = np.lexsort((np.arange(len(df)), -df))
        rank_of = np.empty(len(df), np.int64)
        rank_of[by_frequency] = np.arange(len(df))
        numbers = [np.array([vocabulary[t.encode()] for t in found], np.int64) for _, found in block]
        numbers = [n[df[n] > 0] for n in numbers]
        asked = [(rank_of[n], np.array([weight(head.docs, int(df[i])) for i in n], np.int64)) for n in numbers]
        hits = saved(_hits(rows, asked, rank_of, head.docs, head.terms, top, tree_docs).withColumn("salt", salt_of(F.col("doc_id"), salts=16)), "hits")
        ranked = _ranked(_ranked(hits, ["item", "salt"], top).drop("rank"), ["item"], top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
        found = ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    empty = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return spark.createDataFrame([], empty) if out is None else out
