import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import exact

SCHEMA = "doc_id long, text string, keep_id int, salt string, digest string"
ROWS = [(i, t, 0, "s", "d") for i, t in [(1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (6, "A"), (3, "b"), (None, "a"), (None, "zz"), (8, "x" * 300_000), (9, "x" * 300_000)]]


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t, *_ in rows:
        ids = groups[t or ""]
        best = max((i for i in ids if i is not None), default=None)
        out.append((d, best, len(ids), d == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in exact.exact_duplicates(frame).collect()), key=str) == brute(ROWS)
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_accidents_are_told_apart(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = exact.exact_duplicates(frame, digest=lambda text: F.length(text), salts=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_hot_group(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_duplicates(frame).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 2001, False: 999}
