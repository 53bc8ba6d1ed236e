"""Exact vector search over tables of any size.

The index is parted into the cells of sampled pivots: a vector lies in the cell of its nearest pivot, and a cell knows
the least and the greatest angle of its members to it. A query first searches its home cell; by the triangle inequality
on angles the similarity of its k-th path there tells which other cells may still hold a better one, and only those are
visited. Cells are cut into tiles of bounded size; a tile is a matrix product in Arrow, a slice of queries at a time, and
hands on one row for each query with no more than k paths, none below what the home cell reached. Neither side is
collected and no pair is ever written out; pivots are a bounded sample.

There are few cells and large blocks, so that a vector goes to a few tiles only, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_retrievable, normalize_path
from corpusloom.session import cut_lineage

# Vectors, and numbers in them, that a block has at most; pairs that are looked at together.
BLOCK_ROWS, BLOCK_NUMBERS, TILE_CELLS = 32768, 1 << 21, 1 << 22
# A cell has about CELL_ROWS vectors up to CELLS cells, and a block beyond, as long as MAX_PIVOTS pivots (and PIVOT_NUMBERS
# numbers in them) are enough.
CELL_ROWS, CELLS, MAX_PIVOTS, PIVOT_NUMBERS = 512, 16, 1024, 1_000_000
# Cosines this close to a bound are visited, whatever rounding says.
SLACK = 1e-7
# Similarities are compared after rounding, so that summation order never decides a tie.
TIE_DIGITS = 9


def index_vectors(index: DataFrame) -> DataFrame:
    """One row for each base vector (chunk_index -1, no excerpt) and each chunk vector."""
    base = index.filter(F.size("embedding") > 0).select(
        "path", F.lit(-1).alias("chunk_index"), F.lit(None).cast("string").alias("excerpt"), _doubles("embedding")
    )
    if "chunks" not in index.columns:
        return base
    chunks = index.select("path", F.explode("chunks").alias("c")).select(
        "path",
        F.col("c.index").alias("chunk_index"),
        F.nullif(F.col("c.excerpt"), F.lit("")).alias("excerpt"),
        _doubles("c.embedding"),
    )
    return base.unionByName(chunks.filter(F.size("embedding") > 0))


def _doubles(name: str):
    return F.transform(name, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("embedding")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    return np.divide(m, norms[:, None], out=np.zeros_like(m), where=norms[:, None] > 0)


RESULT_SCHEMA = "query_id string, found array<struct<similarity:double,path:string,chunk_index:int,excerpt:string>>"
_FOUND = pa.struct([("similarity", pa.float64()), ("path", pa.string()), ("chunk_index", pa.int32()), ("excerpt", pa.string())])
_ARROW_RESULT = pa.schema([("query_id", pa.string()), ("found", pa.list_(_FOUND))])


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded similarities of the pairs of rows i of x and j of y."""
    out, step = np.empty(len(i)), max(1, TILE_CELLS // x.shape[1])
    for low in range(0, len(i), step):
        out[low : low + step] = np.einsum("ij,ij->i", x[i[low : low + step]], y[j[low : low + step]])
    return np.round(out, TIE_DIGITS)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each row, sorted by the keys, is the first one with them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return new


def _tile(k: int, min_similarity: float, exclude_self: bool):
    """Function scoring one tile: best vector of each path, then the k best paths of each query."""

    def score(queries: pa.Table, index: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or index.num_rows == 0:
            return _ARROW_RESULT.empty_table()
        # Vectors of one path lie side by side, base first, so a later equal similarity does not win.
        index = index.sort_by([("path", "ascending"), ("chunk_index", "ascending")])
        dim = index.column("dim")[0].as_py()
        paths = index.column("path").to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(_firsts(paths))
        name = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(paths))))
        unit_index, unit_query = (_unit(_matrix(side.column("embedding"), dim)) for side in (index, queries))
        single_index, single_query = unit_index.astype(np.float32), unit_query.astype(np.float32)
        ids = queries.column("query_id").combine_chunks()
        own = np.full(len(ids), -1)
        if exclude_self:
            place = {path: i for i, path in enumerate(paths[firsts])}
            own = np.array([place.get(query_id, -1) for query_id in ids.to_pylist()])
        bounds = np.maximum(queries.column("bound").to_numpy(), min_similarity)
        # What single precision may miss.
        slack = np.float32((dim + 16) * 2.0**-23)
        kept = []
        step = max(1, TILE_CELLS // len(paths))
        for low in range(0, len(ids), step):
            sims = single_query[low : low + step] @ single_index.T
            least = bounds[low : low + step].astype(np.float32) - slack
            able = sims >= least[:, None]
            many = np.flatnonzero(able.sum(axis=1) > 4 * k + 64)
            if len(many) and len(firsts) > k + 1:
                best = sims[many] if len(firsts) == len(paths) else np.maximum.reduceat(sims[many], firsts, axis=1)
                # The query itself may be one of the best.
                at = len(firsts) - k - 1
                able[many] &= sims[many] >= (np.partition(best, at, axis=1)[:, at] - 2 * slack)[:, None]
            i, j = np.nonzero(able)
            i += low
            keep = name[j] != own[i]
            i, j = i[keep], j[keep]
            exact = _exact(unit_query, unit_index, i, j)
            keep = exact >= bounds[i]
            i, j, exact = i[keep], j[keep], exact[keep]
            by = np.lexsort((j, -exact, name[j], i))
            i, j, exact = i[by], j[by], exact[by]
            keep = _firsts(i, name[j])
            i, j, exact = i[keep], j[keep], exact[keep]
            by = np.lexsort((j, -exact, i))  # names are sorted: ties by path
            i, j, exact = i[by], j[by], exact[by]
            starts = np.flatnonzero(_firsts(i)) if len(i) else np.zeros(0, np.int64)
            keep = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < k
            kept.append((i[keep], j[keep], exact[keep]))
        i, j, exact = (np.concatenate(c) for c in zip(*kept))
        if not len(i):
            return _ARROW_RESULT.empty_table()
        taken = index.select(["path", "chunk_index", "excerpt"]).take(pa.array(j))
        columns = [pa.array(exact), *(taken.column(c).combine_chunks() for c in taken.column_names)]
        starts = np.flatnonzero(_firsts(i))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_FOUND)))
        return pa.table([ids.take(pa.array(i[starts])), lists], schema=_ARROW_RESULT)

    return score


def _pivots(index: DataFrame, cell_rows: int, cells: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: a bounded sample of the index, drawn by a hash."""
    rows = index.where(F.exists("embedding", lambda v: v != 0))
    count, longest = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not count:
        return {}
    wanted = max(min(math.ceil(count / cell_rows), cells), math.ceil(count * longest / BLOCK_NUMBERS))
    wanted = max(1, min(wanted, MAX_PIVOTS, PIVOT_NUMBERS // longest))
    drawn = rows.select("dim", "embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(wanted).collect()
    by_dim: dict[int, list] = {}
    for row in drawn:
        by_dim.setdefault(row.dim, []).append(row.embedding)
    return {dim: _unit(np.array(vectors, dtype=np.float64)) for dim, vectors in by_dim.items()}


def _angles(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Row numbers of one dimension, their angles to its pivots (None without pivots), and whether they have a direction."""
    dims = batch.column("dim").to_numpy()
    column = batch.column("embedding")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        unit = _unit(values[offsets[at][:, None] + np.arange(dim)].astype(np.float64))
        known = pivots.get(int(dim))
        yield at, None if known is None else np.arccos(np.clip(unit @ known.T, -1, 1)), unit.any(axis=1)


def _in_cells(index: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (the nearest pivot; -1 without one or without a direction) and angle (to that pivot)."""
    shared = index.sparkSession.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for at, angles, directed in _angles(batch, shared.value):
                if angles is not None:
                    cell[at] = np.where(directed, angles.argmin(axis=1), -1)
                    angle[at] = angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(place, f"{schema}, cell int, angle double")


def _visits(queries: DataFrame, pivots: dict[int, np.ndarray], ranges: dict[tuple[int, int], tuple[float, float]], home: bool) -> DataFrame:
    """query_id, dim, embedding, bound and a cell each: the home cell, or all others that the query's bound does not exclude.

    ``bound`` is the similarity that a path of another cell has to reach. A query without a direction visits all cells.
    """
    shared = queries.sparkSession.sparkContext.broadcast((pivots, ranges))  # one row for each cell

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spans = shared.value
        cells_of: dict[int, list[int]] = {}
        for dim, cell in sorted(spans):
            cells_of.setdefault(dim, []).append(cell)
        for batch in batches:
            dims, bounds = batch.column("dim").to_numpy(), batch.column("bound").to_numpy()
            for at, angles, directed in _angles(batch, known):
                there = np.array(cells_of.get(int(dims[at[0]]), []), dtype=np.int64)
                if not len(there):
                    continue
                if angles is None:
                    near, low = np.full(len(at), there[0]), np.zeros((len(at), len(there)))
                else:
                    placed = there >= 0
                    to_cell = np.where(placed, angles[:, np.maximum(there, 0)], 0.0)
                    least, most = (np.array([spans[int(dims[at[0]]), int(c)][side] for c in there]) for side in (0, 1))
                    low = np.where(placed & directed[:, None], np.maximum(np.maximum(to_cell - most, least - to_cell), 0.0), 0.0)
                    near = there[np.where(placed, to_cell, np.where(placed.any(), np.inf, 0.0)).argmin(axis=1)]
                if home:
                    pick = there[None, :] == near[:, None]
                else:
                    pick = (np.cos(low) >= bounds[at][:, None] - SLACK) & (there[None, :] != near[:, None])
                # A cell at a time, so that what is handed on at once does not grow with the cells.
                for cell, picked in zip(there.tolist(), pick.T):
                    rows = at[picked]
                    if len(rows):
                        taken = batch.select(["query_id", "dim", "embedding", "bound"]).take(pa.array(rows, pa.int64()))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(rows), cell, np.int32))], [*taken.schema.names, "cell"])

    return queries.mapInArrow(visit, "query_id string, dim int, embedding array<double>, bound double, cell int")


def _blocks(block_rows: int) -> Column:
    """How many blocks the vectors of a cell or the queries that visit it make."""
    return F.ceil(F.count(F.lit(1)) / F.least(F.lit(block_rows), F.greatest(F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")), F.lit(1)))).cast("int")


def _search(visits: DataFrame, placed: DataFrame, blocks: DataFrame, score, block_rows: int) -> DataFrame:
    """What the visited cells hold, tile by tile."""
    counts = visits.groupBy("dim", "cell").agg(_blocks(block_rows).alias("qs"))
    tiles = F.broadcast(cut_lineage(blocks.join(counts, ["dim", "cell"])))  # one row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = visits.join(tiles, ["dim", "cell"]).withColumn("q", block("query_id", "qs")).withColumn("m", every("ms"))
    right = placed.join(tiles, ["dim", "cell"]).withColumn("m", block("path", "ms")).withColumn("q", every("qs"))
    keys = ["dim", "cell", "q", "m"]
    wanted = right.select(*keys, "path", "chunk_index", "excerpt", "embedding")
    return left.select(*keys, "query_id", "embedding", "bound").groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(score, RESULT_SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best paths of each query; of a path's equally near vectors the first."""
    each = found.repartition("query_id").select("query_id", F.explode("found").alias("f")).select("query_id", "f.*")
    first = F.max(F.struct("similarity", (-F.col("chunk_index")).alias("place"), "excerpt")).alias("x")
    paths = each.groupBy("query_id", "path").agg(first).select("query_id", "path", "x.similarity", (-F.col("x.place")).alias("chunk_index"), "x.excerpt")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "path")
    return paths.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pivot_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    min_similarity: float,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    max_cells: int | None = None,
) -> DataFrame:
    """The k most similar paths of each query: ``queries(query_id, embedding)``, ``index(path, chunk_index, excerpt, embedding)``.

    Only vectors of equal dimension meet. The result is exact whatever the pivots and blocks are.
    """
    score = _tile(k, min_similarity, exclude_self)
    sized = index.filter(F.size("embedding") > 0).select("path", F.col("chunk_index").cast("int").alias("chunk_index"), "excerpt", "embedding", F.size("embedding").alias("dim"))
    sized = cut_lineage(sized)
    asked = queries.filter(F.size("embedding") > 0).select(
        F.col("query_id").cast("string").alias("query_id"), F.size("embedding").alias("dim"), "embedding", F.lit(float(min_similarity)).alias("bound")
    )
    asked = cut_lineage(asked)
    pivots = _pivots(sized, cell_rows, CELLS if max_cells is None else max_cells)
    placed = cut_lineage(_in_cells(sized, pivots))
    cells = placed.groupBy("dim", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), _blocks(block_rows).alias("ms"))
    cells = cut_lineage(cells)  # one row for each pivot, and one for each dimension
    ranges = {(r.dim, r.cell): (r.low, r.high) for r in cells.collect()}
    blocks = cells.select("dim", "cell", "ms")
    at_home = cut_lineage(_best(_search(_visits(asked, pivots, ranges, True), placed, blocks, score, block_rows), k))
    if len(ranges) == 1:
        return at_home.select("query_id", "path", "similarity", "excerpt", "rank")
    # A query with k paths has to find better ones; it may also find as good ones that come first by path.
    reached = at_home.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("reached"))
    bounded = asked.join(reached, "query_id", "left").select("query_id", "dim", "embedding", F.greatest("bound", F.coalesce("reached", "bound")).alias("bound"))
    others = _search(_visits(cut_lineage(bounded), pivots, ranges, False), placed, blocks, score, block_rows)
    own = at_home.select("query_id", F.array(F.struct("similarity", "path", "chunk_index", "excerpt")).alias("found"))
    return _best(others.union(own), k).select("query_id", "path", "similarity", "excerpt", "rank")


def semantic_topk(queries: DataFrame, index: DataFrame, k: int = 12, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best ``k`` (1..200) paths of each query; a path scores by its best base or chunk vector."""
    return pivot_topk(queries, index_vectors(index), max(1, min(200, k)), 0.0, block_rows=block_rows)


def knn_candidates(
    sources: DataFrame, index: DataFrame, min_similarity: float = 0.12, limit: int = 40, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Neighbours of every source path above a similarity, the path itself left out."""
    queries = sources.select(F.col("path").alias("query_id"), _doubles("embedding"))
    base = index.filter(F.size("embedding") > 0).select(
        "path", F.lit(-1).alias("chunk_index"), F.lit(None).cast("string").alias("excerpt"), _doubles("embedding")
    )
    found = pivot_topk(queries, base, max(1, limit), max(0.0, min_similarity), True, block_rows)
    return found.select(F.col("query_id").alias("source"), F.col("path").alias("target"), "similarity", "rank")


def mean_pool(vectors: DataFrame) -> DataFrame:
    """Average of the vectors of each path: ``vectors(path, chunk_index, embedding)``.

    The first vector's dimension counts; vectors of other dimensions are left out.
    """
    first = vectors.groupBy("path").agg(F.min_by(F.size("embedding"), "chunk_index").alias("dim"))
    sums = (
        vectors.join(first, "path")
        .filter(F.size("embedding") == F.col("dim"))
        .select("path", F.posexplode("embedding").alias("pos", "value"))
        .groupBy("path", "pos")
        .agg(F.avg("value").alias("value"))
    )
    return sums.groupBy("path").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("embedding")
    )


def latest_embeddings(embeddings: DataFrame) -> DataFrame:
    """One record for each retrievable path: the greatest ``created_at``, then the greatest model and other fields.

    Empty vectors do not count.
    """
    eligible = (
        embeddings.withColumn("path", normalize_path("path"))
        .filter(is_retrievable("path") & (F.size("embedding") > 0))
        .withColumn("created_at", F.coalesce("created_at", F.lit("")))
    )
    record = F.struct(*[c for c in eligible.columns if c != "path"])
    latest = eligible.groupBy("path").agg(F.max_by(record, F.struct("created_at", "model", record)).alias("r")).select("path", "r.*")
    return latest.withColumn("model", F.coalesce("model", F.lit(""))).withColumn(
        "content_hash", F.lower(F.trim(F.coalesce("content_hash", F.lit(""))))
    )
