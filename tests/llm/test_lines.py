import random

import pytest

from corpusloom.llm import lines

SCHEMA = "doc_id long, text string, n_chars long, rank string, doc int"


def brute(rows, min_words):
    """Delete what lies in a run of min_words words or more that occurs at an earlier place."""
    where = []  # (document, line, content) of lines with words, in order
    for doc, text in sorted(rows):
        where.append((doc, None, None))
        where += [(doc, i, x) for i, x in enumerate((text or "").split("\n")) if x.split()]
    gone = set()
    for b in range(len(where)):
        for a in range(b):
            n = 0
            while b + n < len(where) and where[a + n][2] is not None and where[a + n][2] == where[b + n][2] and where[b + n][1] is not None:
                n += 1
            if n and sum(len(x[2].split()) for x in where[b : b + n]) >= min_words:
                gone |= {x[:2] for x in where[b : b + n]}
    for one, two in zip(where, where[1:]):  # lines without words go with both their neighbours
        if one[:2] in gone and two[:2] in gone:
            gone |= {(one[0], i) for i in range(one[1], two[1])}
    return {(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows}


def run(spark, rows, min_words):
    frame = spark.createDataFrame([(d, t, len(t or ""), "r", 3) for d, t in rows], SCHEMA).repartition(3)
    out = lines.delete_repeated_runs(frame, min_words=min_words)
    assert out.columns == ["doc_id", "text", "n_chars", "rank", "doc", "n_removed"]
    got = out.collect()
    assert all(r.n_chars == len(r.text or "") for r in got)
    return {(r.doc_id, r.text) for r in got}


@pytest.mark.parametrize("seed,min_words", [(1, 1), (2, 4), (3, 7), (4, 9)])
def test_random_documents(spark, seed, min_words):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(5)] + ["", " ", "x  y"]
    rows = []
    for doc in range(14):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        if rows and rng.random() < 0.5:
            old = (rng.choice(rows)[1] or "").split("\n")
            at = rng.randint(0, len(old))
            text[rng.randint(0, len(text)) :] = old[at : at + rng.randint(1, 9)]
        rows.append((doc, "\n".join(text) if rng.random() < 0.95 else None))
    assert run(spark, rows, min_words) == brute(rows, min_words)


def test_edges(spark):
    long = "\n".join(f"line number {i}" for i in range(120))
    rows = [(1, long), (2, "intro\n" + long + "\nend"), (3, None), (4, ""), (5, "same same\n" * 40), (6, "\n\n")]
    assert run(spark, rows, 50) == brute(rows, 50)
    twice = spark.createDataFrame([(1, long, 1, "r", 1), (1, long, 1, "r", 2), (None, long, 1, "r", 3)], SCHEMA)
    got = {r.doc: r.text for r in lines.delete_repeated_runs(twice).collect()}
    assert got == {1: "", 2: "", 3: long}
    assert lines.delete_repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lines.delete_repeated_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()[0].text == "a"


def test_clashing_columns_and_hot_line(spark):
    """A very common line with many different next lines, and columns that are named as the operator's own."""
    rows = [(i, f"the common line\nown line {i} " + "word " * 60 + f"\nthe common line\nshared {i % 3} " + "more " * 60) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS text_hash", "8 AS runs", "9 AS run_doc", "10 AS run_text")
    got = lines.delete_repeated_runs(frame)
    assert {(r.doc_id, r.text) for r in got.collect()} == brute(rows, 50)
    assert got.select("text_hash", "runs", "run_doc", "run_text").distinct().collect() == [(7, 8, 9, 10)]
