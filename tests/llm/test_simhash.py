import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_edges(spark):
    rows = [(1, None, "x", 9), (2, "", "x", 9), (3, " \t\n", "x", 9), (4, "One two", "x", 9), (5, "oNE TWO", "x", 9),
            (6, "a b c", "x", 9), (7, "É è", "x", 9), (8, "é è", "x", 9), (4, "one two", "x", 9), (9, "w " * 200_000, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].fingerprint == "0" * 16 and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[5].component_id == 4 and by[7].fingerprint != by[8].fingerprint
    assert by[9].fingerprint == f"{brute_fingerprint('w w w'):016x}"
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed,near", [(1, 0.3), (2, 0.9)])
def test_trees_find_all_links(spark, seed, near):
    rng = np.random.default_rng(seed)
    fps = list(rng.integers(0, 2**63, 600, dtype=np.int64))
    while len(fps) < 2000:
        base = int(fps[rng.integers(len(fps))] if rng.random() < near else rng.integers(0, 2**63))
        for bit in rng.choice(63, rng.integers(0, 5), replace=False):
            base ^= 1 << int(bit)
        fps.append(base)
    fps = np.unique(np.array(fps, np.int64))
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(3)
    got = {r.node: r.root for r in components(simhash.near_links(frame, sample=300)).collect()}
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = fps.view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3):
            a, b = sorted((find(int(fps[i])), find(int(fps[i + 1 + j]))))
            parent[b] = a
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want


def test_large_shard_of_one_cluster():
    rng = np.random.default_rng(3)
    spots = [sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(3000)]
    fps = np.unique(np.array([12345, *(12345 ^ x for x in spots)], np.uint64))
    links = simhash.shard_links(fps, 0) + simhash.shard_links(fps, 32)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 2 * 3  # both are near the point that reached them
        root[find(a)] = find(b)
    assert len({find(i) for i in range(len(fps))}) == 1 and len(links) < 10 * len(fps)
    assert all(len(simhash.shard_links(fps[:n], 0)) == 0 for n in (0, 1))


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    assert {r.root for r in components(links).collect()} == {0}


def test_keep_first_keeps_columns(spark):
    rows = [(1, "a b c d", "s", 1), (2, "a b c d", "t", 2), (3, "other words here", "u", 3), (None, "a b c d", "v", 4)]
    out = simhash.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r.fp for r in out.collect()) == ["s", "u", "v"]
