"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from corpusloom.llm import multiindex as mi

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=mi.LEAST_COSINE):
    """n_links and component_id of each row, by position."""
    units = []
    for _, vector, label in rows:
        good = label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        units.append(mi.unit(np.array([vector], np.float64))[0] if good else None)
    near = [[b for b in range(len(rows)) if a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2]
             and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least] for a in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        after = [min([root[a], *(root[b] for b in near[a])]) for a in range(len(rows))]
        if after == root:
            break
        root = after
    smallest = {r: min((rows[a][0] for a in range(len(rows)) if root[a] == r and rows[a][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[a][0], len(near[a]), smallest[root[a]], rows[a][0] == smallest[root[a]]) for a in range(len(rows))), key=repr)


def run(df, **options):
    return sorted((tuple(r) for r in mi.near_duplicate_vectors(df, **options).collect()), key=repr)


def clusters(seed, n, size, dim, spread, labels=3):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = draw.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((len(rows), (3 * (centre + spread * draw.normal(size=dim) / dim**0.5)).astype(np.float32).tolist(), int(c % labels)))
    return rows


def test_multi_sequence_is_the_sorted_order():
    draw = np.random.default_rng(1)
    for _ in range(30):
        a, b = np.sort(draw.integers(0, 20, 7) / 4), np.sort(draw.integers(0, 20, 5) / 4)
        sums = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5))
        got = mi.multi_sequence(a, b, sums[20][0])
        assert len(set(got)) == len(got) and {(i, j) for s, i, j in sums if s <= sums[20][0]} == set(got)
        assert all(x <= y for x, y in zip(*(lambda s: (s, s[1:]))([a[i] + b[j] for i, j in got])))


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.27])
def test_recall_and_exactness(spark, spread):
    rows = clusters(4, 60, 12, 32, spread)
    df = spark.createDataFrame(rows, SCHEMA)
    want, got = {r[0]: r for r in brute(rows)}, {r[0]: r for r in run(df)}
    found, there = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)  # no link below the threshold
    assert found >= 0.98 * there and sum(got[i][2] == want[i][2] for i in want) >= 0.98 * len(want)


def test_tiles_do_not_change_the_result(spark):
    rows = clusters(5, 6, 50, 16, 0.1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df) == brute(rows)
    assert run(df.repartition(5), tile=7) == brute(rows)


def test_hot_vector_and_hot_group(spark):
    rows = clusters(6, 1, 300, 8, 0.05, labels=1) + [(1_000 + i, [1.0, 2.0] + [0.0] * 6, 0) for i in range(400)]
    got, want = run(spark.createDataFrame(rows, SCHEMA), tile=64), brute(rows)
    assert [r[2:] for r in got] == [r[2:] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)


def test_forest_connects_what_hits_connect():
    draw = np.random.default_rng(8)
    for density in (0.0, 0.03, 0.2, 1.0):
        hits = draw.random((30, 25)) < density
        query, member = mi.forest(hits)
        assert ((query >= 0) == hits.any(axis=1)).all() and ((member >= 0) == hits.any(axis=0)).all()
        assert all(query[q] == member[m] for q, m in zip(*np.nonzero(hits)))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, -0.0], 1), (None, [1.0, 0.01], 1), (12, [1.0], 1), (13, [2.0], 1),
        (13, [-2.0], 1), (1, [0.0, 1.0], 1), (14, [1e-30, 1e-30], 3), (15, [1e30, 1e30], 3), (None, [5.0, 5.0], 4), (16, [1.0, 0.0, 0.0], 1),
        (17, [3.0, 0.1, 0.0], 1), (18, [1.0] * 3000, 5), (19, [1.5] * 3000, 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    want = sorted([(a, b, c, a == c) for a, b, c, _ in want], key=repr)
    assert run(df) == want
    clash = df.selectExpr("*", "1 AS vector", "2 AS salt", "3 AS rep", "4 AS n", "5 AS root", "6 AS mask")
    assert run(clash) == want
    assert run(df.limit(0)) == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert run(df) == brute(rows)
