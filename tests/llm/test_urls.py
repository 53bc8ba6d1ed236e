import math
import random
import re
from collections import Counter

from corpusloom.llm import urls

SCHEMA = "page_id long, url string, host int, score string, __gram string"


def brute_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lowered, re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_scores(train, texts, order, least):
    counts = {k: Counter() for k in (True, False)}
    for text, kind in train:
        counts[kind].update(text[i : i + n] for n in range(1, order + 1) for i in range(len(text) - n + 1))
    tree = {g for k in counts.values() for g in k if counts[True][g] + counts[False][g] >= least}
    for kind in counts:
        counts[kind][""] = sum(counts[kind][g] for g in tree if len(g) == 1)

    def chance(kind, gram):
        p = 1 / urls.ALPHABET
        for k in range(1, len(gram) + 1):
            end = gram[len(gram) - k :]
            p = (counts[kind][end] + urls.SMOOTHING * p) / (counts[kind][end[:-1]] + urls.SMOOTHING)
        return p

    def score(text):
        total = 0.0
        for i in range(len(text)):
            known = [text[i - n + 1 : i + 1] for n in range(1, min(order, i + 1) + 1) if text[i - n + 1 : i + 1] in tree]
            if known:
                longest = max(known, key=len)
                total += math.log(chance(True, longest)) - math.log(chance(False, longest))
        return total / max(1, len(text))

    return {t: score(t) for t in texts}


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/EN/x", "http://www.example.com/en/x?q#f", "a://b.example.com/en/", "x://com", "x://com/",
       "x://net/fr/y", "x://a.net#/fr/", "x://notexample.com/en/", "x://É.Net/es/ü?://z", "x://a?b/c://d", "x://h\n/p\nq#r", "x" * 20_000 + "://long.org/" + "y" * 20_000]


def test_rules_match_brute_force(spark, sf):
    given = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = [(i, u, 1, "s", "g") for i, u in enumerate(ODD + given + given[:3])] + [(None, given[0], 1, "s", "g")]
    got = urls.judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, url, *_ in rows:
        host, path = brute_split(url)
        rule = brute_rule(host, path)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule and rule[0])
        assert by[i].verdict == rule[1] if rule else by[i].verdict in ("allow", "block")
    empty = spark.createDataFrame([], SCHEMA)
    assert urls.judge_urls(empty).count() == 0
    assert {r.verdict for r in urls.judge_urls(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect()} == {"allow"}


def test_scores_match_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = pages.select(urls.host(pages.url).alias("host"), urls.path(pages.url).alias("path")).withColumn("text", urls.symbols()).collect()
    train = [(r.text, len(r.host) % 3 > 0) for r in rows]
    frame = spark.createDataFrame(train, "text string, accepted boolean").repartition(3)
    model = urls.train(frame, order=4, min_count=3)
    asked = sorted({t for t, _ in train} | {"", "unseen ✓"})
    got = {r.text: r.score for r in urls.score(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()}
    want = brute_scores(train, asked, 4, 3)
    assert all(abs(got[t] - want[t]) < 1e-5 for t in asked)


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.select(urls.host(pages.url).alias("host"), urls.path(pages.url).alias("path")).distinct().withColumn("text", urls.symbols())
    good, bad = rows.where("not host rlike 'casino|bets|spam'"), rows.where("host rlike 'casino|bets|spam'")
    marked = good.selectExpr("text", "true accepted", "pmod(xxhash64(text), 5) f").union(bad.selectExpr("text", "false", "pmod(xxhash64(text), 5)"))
    model = urls.train(marked.where("f > 1").select("text", "accepted"))
    scored = urls.score(marked, model)
    edge = urls.calibrate(scored.where("f = 0"))
    held = scored.where("f = 1").selectExpr("accepted", f"score >= {edge} as said").collect()
    assert held and sum(r.accepted == r.said for r in held) / len(held) > 0.97


def test_calibration_without_both_kinds(spark):
    assert urls.calibrate(spark.createDataFrame([(0.1, True)], "score double, accepted boolean")) == float("-inf")


def test_every_frequent_gram_has_a_weight(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0-./_", k=40)) for _ in range(1_200)]
    want = {t[i : i + n] for t in texts for n in range(1, 6) for i in range(len(t) - n + 1)}
    assert len(want) > 65_536
    frame = spark.createDataFrame([(t, n % 9 > 0) for n, t in enumerate(texts)], "text string, accepted boolean")
    assert {r.gram for r in urls.train(frame, min_count=1).weights.select("gram").collect()} == want
