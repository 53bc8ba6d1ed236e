"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import lexical as lx

TERM = re.compile(lx.TERM)
LOWER = str.maketrans(lx._UPPER, lx._LOWER)


def found_terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(items, docs, top=10):
    counts = [(i, c) for i, text in docs if (c := found_terms(text))]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(found_terms(text))
    out = set()
    for item, terms in wanted.items():
        scores = []
        for doc, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out |= {(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:top], 1)}
    return out


def run(items, docs, **options):
    rows = lx.ranked_search(items, docs, **options).collect()
    assert len(rows) == len({(r.item_id, r["rank"]) for r in rows})
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}


def test_terms_are_those_of_the_pattern():
    for text in ["", "A-b_C 1é2 Ü!x\x00y", "don't", "漢字、かな ABC", "\x7f~z{Q}", "ſſ K"]:
        assert lx.term_counts(text.encode()) == {t.encode(): n for t, n in found_terms(text).items()}


def random_tree(draw, n, width, copies):
    paths, tfs = [], []
    for _ in range(n):
        if paths and draw.random() < copies:
            at = draw.randrange(len(paths))
            paths.append(paths[at])
            tfs.append(tfs[at])
            continue
        path = sorted(draw.sample(range(width), draw.randint(1, width)), key=lambda r: r)
        paths.append(np.array(path, np.int64))
        tfs.append(np.array([draw.randint(1, 9) for _ in path], np.int32))
    ids = draw.sample(range(10 * n), n)
    return ids, np.array([draw.randint(10, 400) for _ in range(n)], np.int64), paths, tfs


def test_tree_bounds_and_search():
    draw = random.Random(2)
    for n, width, copies, leaf in [(1, 1, 0, 1), (40, 6, 0.3, 2), (200, 12, 0.0, 4), (300, 8, 0.9, 8), (120, 3, 0.5, 1)]:
        ids, m, paths, tfs = random_tree(draw, n, width, copies)
        tree = lx.build(ids, m, paths, tfs, width, leaf)
        assert sorted(tree.doc_id.tolist()) == sorted(ids)
        ranks = np.array(sorted(draw.sample(range(width), draw.randint(1, width))), np.int64)
        weights = np.array([draw.randint(0, 9000) for _ in ranks], np.int64)
        weight_of = np.zeros(width, np.int64)
        weight_of[ranks] = weights
        scores = {i: sum(int(weight_of[r]) * int(lx.share(np.int64(t), mm)) for r, t in zip(p, f)) for i, mm, p, f in zip(ids, m, paths, tfs)}
        bounds = tree.bounds(ranks, weights)
        for node in range(len(tree.low)):
            below = tree.doc_id[tree.low[node] : tree.high[node]].tolist()
            assert bounds[node] >= max(scores[i] for i in below)
            kids = range(tree.first_child[node], tree.first_child[node] + tree.n_children[node])
            assert not kids or sorted(i for k in kids for i in tree.doc_id[tree.low[k] : tree.high[k]].tolist()) == sorted(below)
        best: list = []
        scored = lx.search(tree, ranks, weights, np.zeros(width, np.int64), best, 5)
        want = sorted(((s, -i) for i, s in scores.items() if s), reverse=True)[:5]
        assert sorted(best, reverse=True) == want and scored <= n


def test_whole_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert run(items, docs) == want
    assert run(items, docs.repartition(7), block_terms=50, tree_docs=33) == want


def test_odd_rows(spark):
    docs = [(1, "alpha beta"), (2, "Alpha beta"), (3, None), (None, "alpha alpha"), (5, ""), (6, "... !"), (7, "beta " * 200_000), (8, "gamma"), (8, "gamma alpha")]
    docs += [(i, "delta same words") for i in range(20, 60)]
    items = [(1, "ALPHA, gamma"), (1, "beta"), (2, None), (None, "delta alpha"), (4, "nowhere"), (5, "same delta words words")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(items, docs)
    assert run(i, d) == want
    assert run(i.selectExpr("*", "1 AS item", "2 AS term"), d.selectExpr("*", "1 AS n", "2 AS terms", "3 AS salt", "4 AS score")) == want
    assert run(i, d.limit(0)) == run(i.limit(0), d) == set()
