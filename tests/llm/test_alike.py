import random

import numpy as np

import corpus_pipeline
import test_simhash
from corpusloom.llm import alike, simhash

SCHEMA = "doc_id long, text string, component string"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def planted(families=40, seed=5):
    rng, rows = random.Random(seed), []
    for n in range(families):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 120, 200]))]
        for copy in range(4):
            mine = list(words)
            for _ in range(copy * len(words) // 60):  # up to one changed word in 20: about 0.6 to 1 of the shingles
                mine[rng.randrange(len(mine))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine), "c"))
    return rows


def test_changed_words_link(spark):
    rows = planted()
    texts = {d: t for d, t, _ in rows}
    links = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    bits = {d: simhash.simhash(simhash.shingle_hashes(t.encode())) & (2**64 - 1) for d, t in texts.items()}
    far = [(a, b) for a, b in links if bin(bits[a] ^ bits[b]).count("1") > 3]
    assert len(far) > 20  # which fingerprints alone don't link
    root = {d: c for d, _, c in test_simhash.brute_components([(d, t) for d, t in texts.items()])}
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        root = {d: min(c, root[c]) for d, c in root.items()}
    frame = spark.createDataFrame([*rows, (None, rows[0][1], "c"), (900, None, "c"), (901, " ", "c"), (902, "Two words", "c"), (903, "two  words", "c")], SCHEMA).repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert kept == {d for d, c in root.items() if d == c} | {None, 900, 902}
    assert alike.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0


def test_threshold_is_exact():
    numbers = np.arange(100, dtype=np.uint64)
    assert alike.alike(numbers[:80], numbers) and not alike.alike(numbers[:79], numbers)
    assert alike.alike(numbers[:90], numbers[10:]) is True and alike.alike(numbers[:88], numbers[12:]) is False


def test_a_saved_table_leaves_no_shuffle_files(spark):
    """Rounds of many small queries would fill the disk before the driver collects garbage."""
    import time

    from pyspark.sql import functions as F

    from corpusloom.llm.common import saved

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    data = lambda: {name for f in disk.getAllFiles().mkString("\n").split("\n") if (name := f.rpartition("/")[2]).startswith("shuffle_")}
    before, counts = data(), spark.range(20_000).groupBy((F.col("id") % 977).alias("k")).count()
    table = saved(counts)
    for _ in range(50):
        if not data() - before:
            break
        time.sleep(0.1)
    assert not data() - before
    assert table.count() == counts.count() == 977


def test_a_round_divides_its_keys_in_few_shuffles(spark):
    from corpusloom.llm.common import saved

    rng = random.Random(3)
    rows = [(key, node, node, 9, rng.choice([1, 1, 1, 5, 7])) for key in range(40) for node in range(rng.choice([1, 2, 30]))]
    rows += [(99, node, node, 9, 4) for node in range(20)]  # one component: nothing to compare
    members = saved(spark.createDataFrame(rows, "key long, node long, digest long, size long, component long"))
    found = alike._divided(members, 0)
    held = {}
    for key, node, _, _, component in rows:
        held.setdefault(key, {})[node] = component
    got = {}
    for r in found.collect():
        got.setdefault(r.key, set()).add(r.node)
        own = list(held[r.key].values())
        assert held[r.key][r.leader.node] == r.leader.component
        assert own.count(r.leader.component) == max(map(own.count, own))
    assert got == {key: set(nodes) for key, nodes in held.items() if len(set(nodes.values())) > 1}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = alike._divided(members, 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange ") <= 4
