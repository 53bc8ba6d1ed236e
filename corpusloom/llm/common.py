"""What the operators of this subpackage share: tables, intermediate results, and joins that spread hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

# A mask of 64 bits records on which salts a group has rows.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# Paths that `saved` wrote inside `collected`, by session.
_scratch: dict[str, list[str]] = {}
_collecting: set[str] = set()


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The files that a query inside shuffles go when it ends; else they stay until the driver happens to collect garbage,
    and hundreds of small stages of hundreds of tasks add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    application = spark.sparkContext.applicationId
    if application in _collecting:
        _scratch.setdefault(application, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collected(spark: SparkSession) -> Iterator[None]:
    """What is saved inside belongs to one piece of work, and `clear` deletes it."""
    application = spark.sparkContext.applicationId
    _collecting.add(application)
    try:
        yield
    finally:
        _collecting.discard(application)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    _delete(spark, _scratch.pop(spark.sparkContext.applicationId, []))


def discard(*tables: DataFrame) -> None:
    """Delete what `saved` wrote. Nothing that is still to be computed may read it."""
    for table in tables:
        _delete(table.sparkSession, {name.rpartition("/")[0] for name in table.inputFiles()})


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salt_mask(salt: str) -> Column:
    """An aggregate: the set of a group's salts as bits."""
    return F.expr(f"bit_or(shiftleft(1L, `{salt}`))")


def salts_in(mask: str, salts: int = SALTS) -> Column:
    """The salts whose bits are set, one row each."""
    return F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(`{mask}`, s) & 1L) = 1L)"))


def spare(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until no column of the frames has it."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Salts of tables that are joined again and again, where a mask would cost two more shuffles each time.
FEW_SALTS = 8


def every_salt(groups: DataFrame, salt: str = "salt") -> DataFrame:
    """Slim rows of groups, once for each of FEW_SALTS."""
    return groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(FEW_SALTS - 1))))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join rows with the one row that `groups` has for their keys.

    The rows of a key are spread over salts by a hash of the column `by`, and the group's row is repeated only for the
    salts that its rows have. `rows` has to come out the same when it is computed again, `by` included.
    """
    salt, mask = spare("salt", rows, groups), spare("mask", rows, groups)
    salted = rows.withColumn(salt, salt_of(F.col(by)))
    masks = salted.groupBy(*keys).agg(salt_mask(salt).alias(mask))
    spread = groups.join(masks, keys).withColumn(salt, salts_in(mask)).drop(mask)
    return salted.join(spread, [*keys, salt], how).drop(salt)
