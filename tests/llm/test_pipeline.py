"""The pipeline's stages against brute force on the smallest data set, each on its own input, and its contract."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
import test_alike
import test_lines
import test_packing
import test_rules
import test_simhash
from corpusloom.llm import rules, tokens
from corpusloom.llm.common import saved


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Input of the first stage and output of each, written and read again as a driver does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:5])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]


def test_quality_rules(spark, sf, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = {r.doc_id: r.text for r in steps[0].collect()}, {r.doc_id for r in steps[1].collect()}
    assert after and not any(test_rules.brute(before[d])[5] for d in after)
    fine = [d for d, t in before.items() if not test_rules.brute(t)[5]]
    good = [d for d in fine if labels.get(d) == 1]
    bad = [d for d in fine if labels.get(d) == 0]
    assert all(d in after for d in good) and sum(d in after for d in bad) <= 0.5 * len(bad)  # six labels teach little
    judged = {r.doc_id for r in rules.judge(steps[0], spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert after == judged


def test_line_dedup(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    got = {(r.doc_id, r.text) for r in steps[2].collect()}
    assert got == test_lines.brute(rows, 50)


def brute_first(rows):
    """The ids that stay: the smallest of each group linked by three fingerprint bits or by a Jaccard similarity of 0.8."""
    root = {d: c for d, _, c in test_simhash.brute_components(rows)}
    sets = {d: test_alike.shingles(t or "") for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * max(1, len(sets[a] | sets[b]))]
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        after = {d: min(c, root[c]) for d, c in root.items()}
        if after == root:
            break
        root = after
    return {d for d, c in root.items() if d == c}


def test_near_dedup(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == brute_first(rows)


def test_odd_tables(spark, sf):
    text = "One line of plain words that nobody repeats in any other place. " * 3
    rows = [(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (None, text, None, None, None, "y"), (2, None, "en", "a", None, None), (3, "", "en", None, 0, "z")]
    names = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    for given in (rows, []):
        docs = spark.createDataFrame(given, names)
        for name, stage in corpus_pipeline.STAGES:
            out = saved(stage(spark, docs, sf), name.replace(" ", "-"))
            assert name == "best-fit packing" or out.columns == docs.columns
            docs = docs if name == "best-fit packing" else out


def test_mixing(steps):
    drawn = Counter(r.doc_id for r in steps[4].collect())
    assert set(drawn) == {r.doc_id for r in steps[3].collect()} and set(drawn.values()) <= {1, 2}


def test_packing_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[4].collect()]
    got = steps[5].collect()
    used = test_packing.check(rows, got, Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT)))
    assert used <= 1.03 * sum(r.length for r in got) / 2048 + 40


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op4_exact_dedup", "op8_warc", "op12_ranked_search"} <= set(entry.oracle_sql())
