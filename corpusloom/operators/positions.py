"""Consecutive numbers over a globally sorted table, without putting any group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage


def number_rows(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Add ``position``: 0, 1, 2, ... in the given order over the whole table.

    Rows are range-partitioned and sorted; only one count for each partition is brought together.
    """
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *[F.col(c) for c in order])
    # monotonically_increasing_id numbers rows inside a partition and carries the partition in its upper bits.
    local = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    tagged = cut_lineage(
        local.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    )
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row for each partition of the sort: small whatever the table.
    return tagged.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_before") + F.col("_row")).drop(
        "_part", "_row", "_before"
    )
