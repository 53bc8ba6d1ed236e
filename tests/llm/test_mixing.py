import math
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars int, tokens string, key string"
SIZES = {"big": 900, "mid": 300, "small": 80, None: 30}


def rows():
    out, n = [], 0
    for source, count in SIZES.items():
        for _ in range(count):
            out.append((n, "w " * (1 + n % 7), source, 1, "t", "k"))
            n += 1
    return out


def tokens(text):
    return len((text or "").split()) + 1


def brute_exponent(totals, reached):
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    return high


def entropy(totals, t):
    p = [x / sum(totals) for x in totals]
    w = [x**t / sum(y**t for y in p) for x in p]
    return -sum(x * math.log(x) for x in w)


@pytest.mark.parametrize("repeat", [1.5, 3.0])
def test_repetition_limit(spark, repeat):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = mixing.schedule(frame, max_repeat=repeat, block_docs=20).collect()
    totals, drawn, times = Counter(), Counter(), Counter()
    for doc, text, source, *_ in rows():
        totals[source] += tokens(text)
    for r in got:
        drawn[r.source] += r.tokens
        times[r.doc_id] += 1
    p = {s: totals[s] / sum(totals.values()) for s in totals}
    t = brute_exponent(list(totals.values()), lambda t: max(x ** (t - 1) for x in p.values()) / min(x ** (t - 1) for x in p.values()) <= repeat)
    for s in totals:
        want = (max(p.values()) / p[s]) ** (1 - t)
        assert want - 10 / totals[s] - 1e-4 < drawn[s] / totals[s] < want + 1e-4
    assert set(times) == set(range(len(rows()))) and max(times.values()) <= math.ceil(repeat)
    epochs = defaultdict(set)
    for r in got:
        assert r.doc_id not in epochs[r.epoch]
        epochs[r.epoch].add(r.doc_id)


def test_target_entropy_and_budget(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.schedule(frame, max_repeat=None, entropy_share=0.9, budget=2000).collect()
    totals = Counter()
    for _, text, source, *_ in rows():
        totals[source] += tokens(text)
    t = brute_exponent(list(totals.values()), lambda t: entropy(list(totals.values()), t) <= 0.9 * math.log(4))
    drawn = Counter()
    for r in got:
        drawn[r.source] += r.tokens
    power = {s: x**t for s, x in totals.items()}
    for s in totals:
        want = 2000 * power[s] / sum(power.values())
        assert want - 9 < drawn[s] < want + 0.5
    assert got != sorted(got, key=lambda r: r.doc_id)
    with pytest.raises(ValueError, match="either"):
        mixing.schedule(frame, max_repeat=None)


def test_mix_keeps_columns_and_edges(spark):
    frame = spark.createDataFrame([*rows(), (0, "w ", "big", 1, "t", "k"), (None, None, "small", 1, "t", "k"), (5_000, "w " * 90_000, "huge", 1, "t", "k")], SCHEMA)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == {r.doc_id for r in frame.collect()} and times[0] >= 2 and max(times.values()) <= 4
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", None, 1, "t", "k")], SCHEMA)).count() == 1


def test_thousands_of_equal_sources_lose_nothing(spark):
    frame = spark.createDataFrame([(n, "w w w", f"s{n // 2}", 1, "t", "k") for n in range(6_000)], SCHEMA)
    assert Counter(r.doc_id for r in mixing.mix(frame).collect()) == Counter(range(6_000))


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    clash = frame.selectExpr("*", *(f"5 AS {c}" for c in ("times", "copy", "drawn_id", "drawn_source", "drawn_hash", "epoch", "block", "salt", "mask")))
    out = mixing.mix(clash)
    assert out.columns == clash.columns and {tuple(r) for r in out.collect()} == {tuple(r) for r in clash.collect()}
