"""Mix sources to target weights: temperature, then budgeted block permutations.

A source's weight is its share of tokens to the power of an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected until the weights reach a target entropy, or the smallest one that keeps the most repeated
source within a limit. Each source then gets a token budget, which whole epochs and a part of one more fill: in every
epoch the source's blocks are permuted, and the documents within each block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import salt_mask, salt_of, salts_in, saved, spare

MAX_REPEAT = 1.5
BLOCK_DOCS = 10_000
# Each pass over the sources tries so many exponents at once and narrows the bracket to one step: six halvings a pass.
STEPS = 64
PASSES = 4
SEED = 13


def word_tokens(text: Column) -> Column:
    """Words and one end mark, so that no document is free."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


@dataclass(frozen=True)
class Temperature:
    exponent: float
    normaliser: float  # the sum of the powers
    total: int  # tokens of all sources
    budget: float  # tokens to draw
    entropy: float
    most_repeated: float


def _curves(stats: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float, float, float]]:
    """For each exponent: it, the sum of powers, the entropy, and the largest and smallest power over share."""
    share = F.col("tokens") / F.lit(float(total))
    rows = stats.select(F.explode(F.array(*map(F.lit, exponents))).alias("t"), F.log(share).alias("l"))
    power = F.exp(F.col("t") * F.col("l"))
    ratio = F.exp((F.col("t") - 1) * F.col("l"))
    found = rows.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.col("l")).alias("s"), F.max(ratio).alias("hi"), F.min(ratio).alias("lo"))
    entropy = F.log("z") - F.col("t") * F.col("s") / F.col("z")
    return sorted((r.t, r.z, r.h, r.hi, r.lo) for r in found.select("t", "z", entropy.alias("h"), "hi", "lo").collect())


def find_exponent(stats: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy_share: float | None = None, budget: int | None = None) -> Temperature | None:
    """From source and tokens: the temperature. Give either `max_repeat` or `entropy_share` (of the largest entropy).

    Without `budget` so much is drawn that the least repeated source is read once, so no document is left out. Only a
    few sums for each tried exponent reach the driver, however many sources there are. None if there are no sources.
    """
    head = stats.agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n")).first()
    if not head.n:
        return None
    if (max_repeat is None) == (entropy_share is None):
        raise ValueError("give either max_repeat or entropy_share")
    highest = _curves(stats, head.total, [0.0])[0][2]

    def draw(point: tuple) -> float:
        return float(budget) if budget is not None else head.total * point[1] / point[4]

    def repeats(point: tuple) -> float:
        return point[3] * draw(point) / (point[1] * head.total)

    def reached(point: tuple) -> bool:  # false, then true, as the exponent grows
        return repeats(point) <= max_repeat * (1 + 1e-12) if max_repeat is not None else point[2] <= entropy_share * highest + 1e-12

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = _curves(stats, head.total, [low + (high - low) * i / STEPS for i in range(STEPS + 1)])
        first = next((i for i, point in enumerate(points) if reached(point)), STEPS)
        low, high = points[max(0, first - 1)][0], points[first][0]
    best = next(p for p in points if p[0] == high)
    return Temperature(best[0], best[1], head.total, draw(best), best[2], repeats(best))


def schedule(
    docs: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy_share: float | None = None, budget: int | None = None,
    seed: int = SEED, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, text_hash, tokens, weight, epoch, block, block_order, doc_order.

    Epochs count from 0. Reading by epoch, block_order, doc_order gives each source's permutation. A null source is a
    source of its own, a null text counts as empty, and rows equal in id, text and source are drawn alike. In the last,
    partial epoch a document is drawn if it still fits the source's budget as a whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash"),
            word_tokens(text).alias("tokens"), _key(F.col(source_col)).alias("key"),
        ).withColumns({"draw": F.xxhash64("doc_id", "text_hash", F.lit(seed)), "salt": salt_of(F.col("doc_id"), F.col("text_hash"))}),
        "mix-rows",
    )
    stats = saved(
        rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), salt_mask("salt").alias("mask")), "mix-sources"
    )
    found = find_exponent(stats, max_repeat, entropy_share, budget)
    if found is None:
        found = Temperature(1.0, 1.0, 1, 0.0, 0.0, 0.0)
    weight = F.pow(F.col("tokens") / F.lit(float(found.total)), F.lit(found.exponent)) / F.lit(found.normaliser)
    repeat = F.round(weight * F.lit(found.budget) / F.col("tokens"), 9)  # a whole number of epochs stays one
    sources = stats.select(
        "key", "mask", F.round(weight, 12).alias("weight"), F.floor(repeat).alias("whole"), ((repeat - F.floor(repeat)) * F.col("tokens")).alias("left"),
        F.ceil(F.col("docs") / block_docs).alias("blocks"),
    )
    spread = sources.withColumn("salt", salts_in("mask")).drop("mask")
    placed = rows.join(spread, ["key", "salt"]).withColumn("block", F.pmod("draw", F.col("blocks")))
    epochs = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))).withColumns({
        "block_order": F.xxhash64("key", "block", "epoch", F.lit(seed)), "doc_order": F.xxhash64("draw", "epoch"),
    })
    whole = epochs.where("epoch < whole")
    partial = saved(epochs.where("epoch = whole and left > 0"), "mix-partial")
    blocks = partial.groupBy("key", "block", "block_order").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("key").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("key", "block").orderBy("doc_order", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    fitted = partial.withColumn("until", F.sum("tokens").over(within)).join(blocks, ["key", "block"]).where("earlier + until <= left")
    columns = ["doc_id", "source", "text_hash", "tokens", "weight", "epoch", "block", "block_order", "doc_order"]
    return whole.select(*columns).union(fitted.select(*columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as they are drawn, with all their columns. With the defaults each comes once at least."""
    drawn = schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    d, s, h, n, copy = (spare(name, docs) for name in ("drawn_id", "drawn_source", "drawn_hash", "times", "copy"))
    times = drawn.groupBy(F.col("doc_id").alias(d), _key(F.col("source")).alias(s), F.col("text_hash").alias(h), "epoch").agg(F.lit(1))
    times = times.groupBy(d, s, h).agg(F.count(F.lit(1)).alias(n))
    same = (
        F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (_key(F.col(source_col)) == F.col(s))
        & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(h))
    )
    return docs.join(times, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
