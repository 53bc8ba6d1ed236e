"""Near-duplicate embeddings with an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own; a pair of codewords names a cell of the
product grid. A vector lies in the cell of its two nearest codewords, and as a query it visits cells by the
multi-sequence order of its summed distances, from the nearest on, until the target recall is reached: the slack beyond
the nearest cell is fitted so that this share of partners exactly at the threshold, the hardest ones, lies in a visited
cell. A pair is found if either vector visits the other's cell. What meets in a cell is verified by its cosine.

Equal vectors of a label are one representative. Cells are cut into tiles of bounded size, each one matrix product that
hands on counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import salt_mask, salt_of, salts_in, saved, spread_join
from corpusloom.llm.components import components

LEAST_COSINE = 0.93
# The share of partners at the threshold that a query's visited cells have to hold; both ends of a pair query.
TARGET_RECALL = 0.995
# Directions in which each sampled vector is turned to make such partners.
TURNS = 4
# The codebooks are fitted on so many representatives at most, and on so many numbers.
SAMPLE, SAMPLE_NUMBERS = 16_384, 4_000_000
# A grid has about one cell for so many representatives, and at most MOST_CODES codewords for a half.
CELL_ROWS, MOST_CODES = 32, 256
TILE = 2_048
SEED = 29


# ---- the index


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # neither overflow nor underflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def squared(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(axis=1)[:, None] + (codes**2).sum(axis=1)[None, :] - 2 * rows @ codes.T, 0.0)


def codebook(rows: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from rows drawn with a fixed seed; a codeword that loses all rows stays where it is."""
    book = rows[np.random.default_rng(SEED).choice(len(rows), codes, replace=False)]
    for _ in range(rounds):
        nearest = squared(rows, book).argmin(axis=1)
        sizes = np.bincount(nearest, minlength=codes)
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, rows)
        book = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], book)
    return book


def multi_sequence(left: np.ndarray, right: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Ranks (i, j) by growing left[i] + right[j], from two ascending arrays, as long as the sum is within the limit."""
    heap, taken, out = [(left[0] + right[0], 0, 0)], set(), []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        out.append((i, j))
        taken.add((i, j))
        if i + 1 < len(left) and (j == 0 or (i + 1, j - 1) in taken):
            heapq.heappush(heap, (left[i + 1] + right[j], i + 1, j))
        if j + 1 < len(right) and (i == 0 or (i - 1, j + 1) in taken):
            heapq.heappush(heap, (left[i] + right[j + 1], i, j + 1))
    return out


@dataclass
class Grid:
    """Codebooks of two halves, and how far beyond its nearest cell a query goes."""

    left: np.ndarray
    right: np.ndarray
    slack: float = 0.0

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = rows.shape[1] // 2
        return squared(rows[:, :half], self.left), squared(rows[:, half:], self.right)

    def homes(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.distances(rows)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def visits(self, rows: np.ndarray) -> list[list[int]]:
        """The cells of each row in multi-sequence order; the first is its home."""
        a, b = self.distances(rows)
        by_a, by_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        width, out = len(self.right), []
        for i in range(len(rows)):
            ranks = multi_sequence(a[i], b[i], a[i, 0] + b[i, 0] + self.slack)
            out.append([int(by_a[i, x]) * width + int(by_b[i, y]) for x, y in ranks])
        return out

    def excess(self, queries: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """How much farther from each query its partner's cell is than its own nearest cell."""
        a, b = self.distances(queries)
        at = np.arange(len(queries))
        cells = self.homes(partners)
        return a[at, cells // len(self.right)] + b[at, cells % len(self.right)] - a.min(axis=1) - b.min(axis=1)


def fit_grid(sample: np.ndarray, codes: int, least: float = LEAST_COSINE, recall: float = TARGET_RECALL) -> Grid:
    """From sampled vectors: codebooks, and the slack that reaches the target recall for partners at the threshold.

    The partners are the sampled vectors turned by the threshold's angle, towards random directions.
    """
    rows = unit(sample)
    codes = max(1, min(codes, len(rows)))
    half = rows.shape[1] // 2
    grid = Grid(codebook(rows[:, :half], codes), codebook(rows[:, half:], codes))
    draw, excess = np.random.default_rng(SEED + 1), []
    for _ in range(TURNS):
        turn = draw.normal(size=rows.shape)
        turn -= (turn * rows).sum(axis=1, keepdims=True) * rows
        length = np.linalg.norm(turn, axis=1, keepdims=True)
        turn = np.divide(turn, length, out=np.zeros_like(turn), where=length > 1e-12)
        excess.append(grid.excess(rows, least * rows + np.sqrt(max(0.0, 1 - least**2)) * turn))
    grid.slack = float(np.quantile(np.concatenate(excess), recall, method="higher")) + 1e-9
    return grid


# ---- links within a tile


def tile_links(queries: np.ndarray, members: np.ndarray, same: np.ndarray, least: float) -> np.ndarray:
    """hits[q, m]: the cosine of two different representatives reaches the threshold."""
    return (queries @ members.T >= least) & ~same


def forest(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and each member the member that stands for its connected part; -1 where nothing hits."""
    nothing = hits.shape[1]
    member = np.where(hits.any(axis=0), np.arange(nothing), nothing)
    while True:
        query = np.where(hits, member[None, :], nothing).min(axis=1, initial=nothing)
        after = np.minimum(member, np.where(hits, query[:, None], nothing).min(axis=0, initial=nothing))
        if (after == member).all():
            return np.where(query < nothing, query, -1), np.where(member < nothing, member, -1)
        member = after


# ---- the operator


def _representatives(rows: DataFrame) -> DataFrame:
    """From vec_id, label, vector, salt: rep (a unique number), first_id, n and mask of each label's distinct vectors."""
    groups = rows.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), salt_mask("salt").alias("mask"))
    return saved(groups.withColumns({"rep": F.monotonically_increasing_id(), "dim": F.size("vector")}), "representatives")


def _grids(reps: DataFrame, least: float, recall: float) -> dict[int, Grid]:
    """A grid for each length of vectors in a bounded sample; vectors of other lengths share one cell each."""
    total = reps.count()
    if not total:
        return {}
    longest = reps.agg(F.max("dim")).first()[0]
    size = max(1, min(SAMPLE, SAMPLE_NUMBERS // longest))
    drawn = reps.select("vector", "dim").orderBy(F.xxhash64("vector", F.lit(SEED)), "vector").limit(size).collect()
    by_dim: dict[int, list] = {}
    for row in drawn:
        by_dim.setdefault(row.dim, []).append(row.vector)
    return {
        dim: fit_grid(np.array(found, np.float64), min(MOST_CODES, round((total * len(found) / len(drawn) / CELL_ROWS) ** 0.5)), least, recall)
        for dim, found in by_dim.items()
    }


def _placed(reps: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """rep, label, dim, n, vector (unit, as bytes), home and cells (those visited, home first)."""
    shared = reps.sparkSession.sparkContext.broadcast(grids)  # MOST_CODES codewords a half at most, of sampled lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            vectors = batch.column(4)
            offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            packed: list[bytes] = [b""] * len(batch)
            cells: list[list[int]] = [[0]] * len(batch)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = unit(values[offsets[at][:, None] + np.arange(dim)])
                for i, row in zip(at, rows):
                    packed[i] = row.tobytes()
                if int(dim) in shared.value:
                    for i, found in zip(at, shared.value[int(dim)].visits(rows)):
                        cells[i] = found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(packed, pa.binary()), pa.array([c[0] for c in cells], pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                ["rep", "label", "dim", "n", "vector", "home", "cells"],
            )

    rows = reps.select("rep", "label", "dim", "n", "vector")
    return saved(rows.mapInArrow(place, "rep long, label string, dim int, n long, vector binary, home int, cells array<int>"), "placed")


def _tiles(placed: DataFrame, tile: int) -> DataFrame:
    """One row for each part (0 member, 1 query) that a representative takes in a tile: tile (a name), part, rep."""
    blocks = lambda n: F.ceil(F.col(n) / tile).cast("int")
    visits = placed.select("rep", "label", "dim", "home", F.explode("cells").alias("cell")).withColumn("by", F.xxhash64("rep"))
    cells = visits.groupBy("label", "dim", "cell").agg(
        F.count_if(F.col("cell") == F.col("home")).alias("members"), F.count(F.lit(1)).alias("queries")
    ).where("members > 0 and queries > 1").select("label", "dim", "cell", blocks("members").alias("mb"), blocks("queries").alias("qb"))
    met = spread_join(visits, saved(cells, "cells"), ["label", "dim", "cell"], "by")
    own = lambda n: F.pmod("by", F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = met.select("*", F.lit(1).alias("part"), own("qb").alias("q"), F.explode(every("mb")).alias("m"))
    held = met.where("cell = home").select("*", F.lit(0).alias("part"), F.explode(every("qb")).alias("q"), own("mb").alias("m"))
    return asked.unionByName(held).select("rep", "part", F.concat_ws("|", "dim", "cell", "m", "q", "label").alias("tile"))


def _found(placed: DataFrame, least: float, tile: int) -> DataFrame:
    """Rows (a, b, n): links a, b of a spanning forest, and, where b is null, n more vectors that a links with."""

    def blank() -> dict[str, list]:
        return {"rep": [], "n": [], "vector": [], "home": [], "cells": []}

    def settle(members: dict, queries: dict) -> pa.RecordBatch | None:
        if not members["rep"] or not queries["rep"]:
            return None
        m_rep, q_rep = np.array(members["rep"]), np.array(queries["rep"])
        matrix = lambda side: np.frombuffer(b"".join(side["vector"]), np.float64).reshape(len(side["rep"]), -1)
        hits = tile_links(matrix(queries), matrix(members), q_rep[:, None] == m_rep[None, :], least)
        if not hits.any():
            return None
        m_n, q_n = np.array(members["n"]), np.array(queries["n"])
        homes, home_of = np.unique(queries["home"], return_inverse=True)
        returns = np.array([np.isin(homes, cells) for cells in members["cells"]])  # the member visits the query's home itself
        to_query = hits @ m_n
        to_member = (hits & ~returns[:, home_of].T).T @ q_n
        query, member = forest(hits)
        a, b = [q_rep[query >= 0], m_rep[member >= 0]], [m_rep[query[query >= 0]], m_rep[member[member >= 0]]]
        links = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        links = links[links[:, 0] != links[:, 1]]
        gained_rep = np.concatenate([q_rep[to_query > 0], m_rep[to_member > 0]])
        gained = np.concatenate([to_query[to_query > 0], to_member[to_member > 0]])
        none = [None] * len(gained)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([links[:, 0], gained_rep])), pa.array([*links[:, 1].tolist(), *none], pa.int64()), pa.array(np.concatenate([np.zeros(len(links), np.int64), gained]))],
            ["a", "b", "n"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tile, sides = None, (blank(), blank())
        for batch in batches:
            for name, part, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if name != open_tile:
                    if (out := settle(*sides)) is not None:
                        yield out
                    open_tile, sides = name, (blank(), blank())
                for column, value in zip(sides[part], values):
                    sides[part][column].append(value)
        if (out := settle(*sides)) is not None:
            yield out

    dealt = _tiles(placed, tile).join(placed.select("rep", "n", "vector", "home", "cells"), "rep")
    dealt = dealt.select("tile", "part", "rep", "n", "vector", "home", F.when(F.col("part") == 0, F.col("cells")).alias("cells"))
    return saved(dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long, n long"), "vector-links")


def near_duplicate_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = LEAST_COSINE, recall: float = TARGET_RECALL, tile: int = TILE,
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id (smallest id reachable), kept.

    Vectors link when their labels and lengths are equal and their cosine is `least` or more. Vectors that are null,
    empty, zero or hold null or non-finite numbers, and those without a label, link with nothing and stay. Rows with
    the same id are vectors of their own, and so are equal rows. A null id is the smallest of its component only where
    there is no other; it is kept there, and not elsewhere. An empty table gives no rows. Other columns are ignored.
    """
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero, not two
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fit = F.coalesce(F.col("label").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(fit, F.col("vector"))).withColumn("salt", salt_of(F.coalesce("vec_id", F.lit(0))))
    usable = rows.where("vector is not null")
    reps = _representatives(usable)
    placed = _placed(reps, _grids(reps, least, recall))
    found = _found(placed, least, tile)
    roots = components(found.where("b is not null").select("a", "b"))
    more = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    named = reps.select("rep", "label", "vector", "first_id", "n", "mask").join(more, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = saved(named.withColumn("root", F.coalesce("root", "rep")).withColumn("by", F.xxhash64("rep")), "vector-classes")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = spread_join(named, smallest, ["root"], "by").select(
        "label", "vector", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id", salts_in("mask").alias("salt")
    )
    linked = usable.join(classes, ["label", "vector", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
