"""Best-fit packing of tokenised documents with a grouping genetic algorithm.

Pieces that fill a sequence alone are placed at once. The others are dealt to shards of bounded size, and several
islands evolve packings of the same shard: crossover injects whole well-filled sequences of one parent into the other,
sequences that then hold a piece twice are broken up, and displaced pieces go where they fit best. Between epochs the
islands of a shard meet in a shuffle: each gets the elite of its neighbour as a further parent. A last round mixes the
poorly filled sequences of different shards. Texts never enter the shuffles; only lengths do.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.common import saved

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 1_000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
# A sequence this full is not worth opening again in the last round.
WELL_FILLED = 0.98
SEED = 7

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and cut: one row for each piece. `copy` is a number that tells rows with the same id apart.

    A document is its token ids and END_ID. A longer one than `capacity` is cut into pieces of `capacity`, of which the
    first takes the remainder. A null text is an empty one: one piece that holds END_ID alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, copy, text in zip(*(column.to_pylist() for column in batch.columns)):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for number, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc_id, copy, number, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


# ---- one island. A packing is a list of sequences, each a list of item numbers.

Packing = list[list[int]]


def filled(lengths: list[int], groups: Packing) -> list[int]:
    return [sum(lengths[i] for i in g) for g in groups]


def best_fit(lengths: list[int], order: list[int], capacity: int, groups: Packing) -> Packing:
    """Put items where the least room is left, or into a new sequence. `groups` is extended and returned."""
    room = sorted((capacity - f, i) for i, f in enumerate(filled(lengths, groups)) if f < capacity)
    for item in order:
        need = lengths[item]
        at = bisect.bisect_left(room, (need, -1))
        if at == len(room):
            groups.append([item])
            left, group = capacity, len(groups) - 1
        else:
            left, group = room.pop(at)
            groups[group].append(item)
        if left > need:
            bisect.insort(room, (left - need, group))
    return groups


def least_sequences(lengths: list[int], capacity: int) -> int:
    """A lower bound: items of over half a sequence stand alone, and small ones fill what room those leave, or more."""
    falling = np.sort(np.asarray(lengths, np.int64))[::-1]
    total = np.concatenate(([0], np.cumsum(falling)))
    best = -(-int(total[-1]) // capacity)
    half = int((falling > capacity // 2).sum())
    for small in np.unique(falling[half:]):
        huge = int((falling > capacity - small).sum())
        last = int((falling >= small).sum())
        room = (half - huge) * capacity - int(total[half] - total[huge])
        best = max(best, half + max(0, -(-(int(total[last] - total[half]) - room) // capacity)))
    return max(best, half)


def fitness(lengths: list[int], groups: Packing) -> tuple[int, int]:
    """Fewer sequences first; then fuller ones, which leaves the waste in few places."""
    return -len(groups), sum(f * f for f in filled(lengths, groups))


def reinsert(lengths: list[int], groups: Packing, loose: list[int], capacity: int) -> Packing:
    """Put loose items back: first each swaps with one or two smaller ones where that fills a sequence better, then best fit."""
    sizes = sorted((lengths[item], item) for item in loose)
    for g in groups:
        room = capacity - sum(lengths[i] for i in g)
        if not room or not sizes:
            continue
        best = (0, None, None)
        for out in [*((i,) for i in g), *itertools.combinations(g, 2)] if len(g) <= 24 else [(i,) for i in g]:
            size = sum(lengths[i] for i in out)
            at = bisect.bisect_right(sizes, (size + room, len(lengths))) - 1
            if at >= 0 and sizes[at][0] - size > best[0]:
                best = (sizes[at][0] - size, out, at)
        if best[0]:
            g.append(sizes.pop(best[2])[1])
            for i in best[1]:
                g.remove(i)
                bisect.insort(sizes, (lengths[i], i))
    return best_fit(lengths, [i for _, i in reversed(sizes)], capacity, groups)


def crossover(lengths: list[int], a: Packing, b: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject well-filled sequences of `a` into `b`, break up those of `b` that share an item, re-insert what is displaced."""
    draws = rng.random(len(a))
    injected = [list(g) for g, f, r in zip(a, filled(lengths, a), draws) if r < 0.5 * (f / capacity) ** 8]
    taken = {item for g in injected for item in g}
    kept, displaced = [], []
    for g in b:
        if taken.isdisjoint(g):
            kept.append(list(g))
        else:
            displaced += [item for item in g if item not in taken]
    return reinsert(lengths, injected + kept, displaced, capacity)


def mutate(lengths: list[int], groups: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Break up the emptiest sequences and some others, and re-insert their items."""
    worth = np.array(filled(lengths, groups)) + rng.integers(0, capacity // 4, len(groups))
    broken = set(np.argsort(worth, kind="stable")[: max(2, len(groups) // 12)].tolist())
    loose = [item for i in broken for item in groups[i]]
    return reinsert(lengths, [list(g) for i, g in enumerate(groups) if i not in broken], loose, capacity)


def evolve(
    lengths: list[int], capacity: int, rng: np.random.Generator, elites: list[Packing], generations: int = GENERATIONS, population: int = POPULATION
) -> Packing:
    """The best packing after some generations; evolution ends early where the lower bound shows that none is better."""
    least, sizes = least_sequences(lengths, capacity), np.array(lengths)
    ranked = sorted(((fitness(lengths, e), e) for e in elites), key=lambda x: x[0], reverse=True)
    while len(ranked) < population and not (ranked and -ranked[0][0][0] <= least):
        jitter = 1 + 0.15 * rng.random(len(sizes)) * bool(ranked)
        made = best_fit(lengths, np.argsort(-sizes * jitter, kind="stable").tolist(), capacity, [])
        ranked = sorted([*ranked, (fitness(lengths, made), made)], key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -ranked[0][0][0] <= least:
            break
        a, b = ranked[0][1], ranked[1 + int(rng.integers(len(ranked) - 1))][1]
        children = [crossover(lengths, a, b, capacity, rng), mutate(lengths, a, capacity, rng)]
        ranked = sorted([*ranked, *((fitness(lengths, c), c) for c in children)], key=lambda x: x[0], reverse=True)[: max(2, population)]
    return ranked[0][1]


def _labels(groups: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    for number, g in enumerate(groups):
        out[g] = number
    return out


def _groups(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(g)]


# ---- the islands in Spark

ITEMS = "shard long, island int, item long, length long, elite int, bin long, score double"


def _epoch(items: DataFrame, capacity: int, epoch: int, seed: int) -> DataFrame:
    """Evolve every island once. In: for each (shard, island) its items under each elite it got (-1: none yet)."""

    def island(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["elite", "item"], kind="stable")
        parts = [part for _, part in rows.groupby("elite", sort=True)]
        item, lengths = parts[0]["item"].to_numpy(), parts[0]["length"].to_numpy()
        elites = [_groups(p["bin"].to_numpy()) for p in parts if p["elite"].iloc[0] >= 0]
        rng = np.random.default_rng([seed, epoch, int(key[0]) & 0xFFFFFFFF, int(key[1])])
        best = evolve(lengths.tolist(), capacity, rng, elites)
        count, fill = fitness(lengths.tolist(), best)
        return pd.DataFrame({
            "shard": key[0], "island": key[1], "item": item, "length": lengths, "elite": key[1], "bin": _labels(best, len(item)),
            "score": count + fill / (capacity * capacity * (len(best) + 1.0)),
        })

    return items.groupBy("shard", "island").applyInPandas(island, ITEMS)


def evolve_shards(items: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """shard, item, length in; the best packing of each shard out: shard, item, length, bin."""
    state = items.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "item", "length",
        F.lit(-1).alias("elite"), F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("score"),
    )
    for epoch in range(epochs):
        state = saved(_epoch(state, capacity, epoch, seed), "islands")
        if epoch + 1 < epochs and islands > 1:  # the elite of each island also goes to the next one
            state = state.withColumn("island", F.explode(F.array("island", (F.col("island") + 1) % islands)))
    scores = state.select("shard", "island", "score").distinct()
    best = scores.groupBy("shard").agg(F.max(F.struct("score", (-F.col("island")).alias("i"))).alias("best")).select("shard", (-F.col("best.i")).alias("island"))
    return state.join(best, ["shard", "island"]).select("shard", "item", "length", "bin")


def dealt(items: DataFrame, total: int, size: int, seed: int) -> DataFrame:
    """Deal items to shards at random, about `size` to each."""
    shards = max(1, -(-total // size))
    return items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(shards)))


def pack(found: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Add sequence_id and offset to pieces (at most `capacity` long). An empty table gives no rows."""
    named = saved(found.withColumn("item", F.col("copy")), "pieces")  # only one piece of a document is not full
    alone = named.where(F.col("length") >= capacity)
    loose = named.where(F.col("length") < capacity).select("item", "length")
    total = loose.count()
    first = evolve_shards(dealt(loose, total, shard_pieces, seed), capacity, islands, epochs, seed)
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("filled"))
    first = saved(first.join(fills, ["shard", "bin"]), "first-round")
    settled = first.where(F.col("filled") >= WELL_FILLED * capacity)
    open_again = first.where(F.col("filled") < WELL_FILLED * capacity).select("item", "length")
    rest = open_again.count()
    last = evolve_shards(dealt(open_again, rest, 2 * shard_pieces, seed + 1), capacity, islands, epochs, seed + 1)
    placed = settled.select("item", F.lit(1).alias("round"), "shard", "bin").union(last.select("item", F.lit(2).alias("round"), "shard", "bin"))
    # The numbers of sequences: shards and bins are small numbers, pieces on their own are named by their own place.
    numbered = placed.select("item", (((F.col("shard") * 2 + F.col("round") - 1) * 65_536 + F.col("bin")) * 2).alias("sequence_id"))
    singles = alone.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
    both = named.where(F.col("length") < capacity).join(numbered, "item").select(*singles.columns).union(singles)
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).drop("item")


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **options: int
) -> DataFrame:
    """Tokenise, cut and pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset; copy.

    Null texts count as empty, null ids stay null, rows that repeat an id are packed each (told apart by `copy`), and
    other columns of the input are ignored. Sequence numbers are arbitrary.
    """
    cut = pieces(docs, tokenizer or public_tokenizers.path(tokens.DEFAULT), capacity, id_col, text_col)
    return pack(cut, capacity, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy")
