import random
import re

import pandas as pd

from corpusloom.llm import rules

SCHEMA = "doc_id long, text string, n_words string, kept int, quality int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for starts in windows.values() if len(starts) > 1 for i in starts for j in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(5)
    odd = [None, "", " \n\t", "a b c d e a b c d e", "a " * 40, "x\ny\nx\n\n\n z\r\nz", "ü #| é\x0b\x1c\x85ñ 12 AB", "w" * 100_000]
    odd += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id: brute(r.text) for r in frame.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(frame, labels).collect()}
    assert got == want


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    sample = rules.labelled_sample(docs, labels)
    train, held = sample[sample.index % 2 == 0], sample[sample.index % 2 == 1]
    found = rules.learn(train)
    rejected = pd.Series(False, held.index)
    for rule in found:
        rejected |= rules._covers(rule, held)
    bad = held["quality"] == 0
    assert found and (rejected[bad].mean() > 0.9) and (rejected[~bad].mean() < 0.01), [" and ".join(map(str, r)) for r in found]


def test_rules_are_grown_pruned_and_ordered():
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        row = {f: rng.random() for f in rules.FEATURES} | {"fold": i % 3}
        row["quality"] = int(not (row["symbols_per_word"] > 0.7 and row["chars_per_word"] < 0.5 or row["digits_per_char"] > 0.9))
        rows.append(row)
    data = pd.DataFrame(rows)
    found = rules.learn(data)
    hit = pd.Series(False, data.index)
    for rule in found:
        hit |= rules._covers(rule, data)
    assert (hit == (data["quality"] == 0)).mean() > 0.98 and len(found) <= 6
    assert rules.learn(data[:0]) == [] and rules.learn(data.assign(quality=1)) == []


def test_edges(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "x", 1, 0), (1, None, "x", 1, 0), (2, good, "x", 1, 0), (None, good, "x", 1, 0), (3, "", "x", 1, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or 0, r.kept) for r in rules.judge(frame, none).collect()) == [(0, True), (1, False), (1, True), (2, True), (3, False)]
    kept = rules.keep_good(frame, none)
    assert kept.columns == frame.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    clash = frame.selectExpr("*", "1 AS counts", "2 AS n_lines", "3 AS gone")
    assert rules.keep_good(clash, none).count() == 3 and rules.keep_good(clash, none).columns == clash.columns
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    assert rules.judge(frame, nulls).count() == 5
    assert rules.judge(spark.createDataFrame([], SCHEMA), nulls).count() == 0


def test_repeated_labelled_ids_do_not_depend_on_order(spark):
    rows = [(1, f"text number {n} with some words to count and more", "x", 1, 0) for n in range(30)]
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    samples = [rules.labelled_sample(spark.createDataFrame(rows[::step], SCHEMA).repartition(5), labels) for step in (1, -1)]
    assert len(samples[0]) == 1 and samples[0].equals(samples[1])
