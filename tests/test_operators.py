"""Operators on small tables, against brute force where there is one."""

import itertools
import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import duplicates as du
from corpusloom.operators import duplicates as dd
from corpusloom.operators import facts as fa
from corpusloom.operators import links as lk
from corpusloom.operators import maintenance as mt
from corpusloom.operators import planning as pl
from corpusloom.operators import retrieval as rt
from corpusloom.operators import texts as ts
from corpusloom.operators import vectors as vx
from corpusloom.operators.positions import number_rows
from corpusloom.plans import queries_retrieval


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [(f"p{i:03d}", rng.normal(size=dim).tolist()) for i in range(n)]


@pytest.mark.parametrize("block_rows", [5, 16, 10_000])
def test_grid_topk_is_exact_for_any_blocks(spark, block_rows):
    rows = vectors(60, 8)
    rows[7] = ("p007", rows[3][1])  # a tie
    index = spark.createDataFrame(rows + [("odd", [1.0, 2.0])], "path string, embedding array<double>")
    queries = index.select(F.col("path").alias("query_id"), "embedding").filter("path <> 'odd'")
    got = {}
    for r in vx.semantic_topk(queries, index, 5, block_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.path))
    m = np.array([v for _, v in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    for i, (path, _) in enumerate(rows):
        want = sorted((-sims[i, j], rows[j][0]) for j in range(len(rows)) if sims[i, j] >= 0)[:5]
        assert [p for _, p in sorted(got[path])] == [p for _, p in want]


def test_chunk_vectors_win_only_when_better(spark):
    chunk = "array<struct<index:int,start:int,end:int,excerpt:string,embedding:array<double>>>"
    index = spark.createDataFrame(
        [("a", [1.0, 0.0], [(0, 0, 1, "same", [1.0, 0.0])]), ("b", [0.0, 1.0], [(0, 0, 1, "better", [1.0, 0.1])])],
        f"path string, embedding array<double>, chunks {chunk}",
    )
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = {r.path: r.excerpt for r in vx.semantic_topk(query, index, 5).collect()}
    assert got == {"a": None, "b": "better"}


def keyword_score(query, path, content):
    q = query.strip().lower()
    name, where, text = path.split("/")[-1].lower(), path.lower(), content.lower()
    score = 120 * (q in name) + 60 * (q in where) + 40 * (q in text)
    return score + sum(20 * (t in name) + 10 * (t in where) + 4 * (t in text) for t in q.split())


@pytest.mark.parametrize("block", [2, 2048])
def test_keyword_search_equals_brute_force(spark, block):
    rng = random.Random(3)
    words = ["plan", "a", "budget", "met", "metrics", "team", "x1"]
    docs = [(f"f{i % 3}/{rng.choice(words)} {i:02d}.md", " ".join(rng.choices(words, k=6))) for i in range(40)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(9)] + [("q9", "  ")]
    d = spark.createDataFrame(docs, "path string, content string")
    q = spark.createDataFrame(queries, "query_id string, query string")
    from corpusloom.operators import scoring

    scoring_default = scoring.best_texts.__defaults__
    asked = q.filter(F.trim("query") != "").select("query_id", rt.search_tokens("query").alias("tokens"), F.lower(F.trim("query")).alias("phrase"))
    texts = d.select(F.col("path").alias("key"), F.lower(F.substring_index("path", "/", -1)).alias("name"), F.lower("path").alias("path"), F.lower("content").alias("content"))
    top = scoring.best_texts(asked, texts, rt.TOKEN_WEIGHTS, rt.PHRASE_WEIGHTS, 7, query_block_rows=block, text_block_rows=15)
    assert scoring.best_texts.__defaults__ == scoring_default
    got = {}
    for r in top.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.key, int(r.score)))
    for qid, query in queries[:9]:
        want = sorted((-s, p) for p, c in docs if (s := keyword_score(query, p, c)) > 0)[:7]
        assert [(p, s) for _, p, s in sorted(got.get(qid, []))] == [(p, -s) for s, p in want]


def brute_duplicates(files):
    """Leaders in preference order: each file goes to the best better file that is near it and is itself kept."""
    flagged, kept = {}, []
    for f in sorted(files, key=lambda f: f["key"]):
        near = [k for k in kept if k["stem"] and k["stem"] == f["stem"] and is_near(f, k)]
        if near:
            flagged[f["path"]] = min(near, key=lambda k: k["key"])["path"]
        else:
            kept.append(f)
    return flagged


def is_near(a, b):
    sa, sb = set(a["words"]), set(b["words"])
    sim = len(sa & sb) / len(sa | sb) if sa and sb else 0
    noisy = a["key"].noise > 0 or b["key"].noise > 0
    same = a["folder"] == b["folder"]
    la, lb = len(a["normalized"]), len(b["normalized"])
    return a["hash"] != b["hash"] and (same or noisy) and min(la, lb) / max(la, lb) >= 0.72 and round(sim, 9) >= (0.55 if same and noisy else 0.74)


def test_near_duplicates_equal_greedy_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(40)]
    bases = [rng.sample(vocabulary, 20) for _ in range(4)]
    rows = []
    for i in range(48):
        words = list(bases[i % 4])
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(20)] = rng.choice(vocabulary)
        mark = rng.choice(["", " copy", " draft", " final", " (2)", " v2"])
        rows.append((f"{rng.choice(['a', 'b'])}/{i // 24}{'x' * (i % 3)} report{mark}{'.md' if i % 2 else '.txt'}", " ".join(words) + f" tail{i}"))
    rows = list({p: (p, c) for p, c in rows}.values())
    profile = dd.duplicate_profile(spark.createDataFrame(rows, "path string, content string"))
    files = [r.asDict() for r in profile.withColumn("words", du.word_set("normalized")).collect()]
    got = {r.path: r.target for r in dd.near_duplicates(profile).collect()}
    assert got == brute_duplicates(files) and got


def test_exact_duplicates_respect_roles(spark):
    text = "the very same content of some length"
    rows = [("a/x.md", text, "guide"), ("b/x copy.md", text.upper() + "\n\n---\n", "text-note"), ("c/x final.md", text, "resume")]
    found = dd.detect_duplicates(spark.createDataFrame(rows, "path string, content string, file_role string")).collect()
    assert [(r.path, r.kind, r.target, r.reason) for r in found] == [("b/x copy.md", "exact-delete", "a/x.md", "Exact duplicate of cleaner canonical file a/x.md")]


def test_chunks_cover_and_bound(spark):
    text = ". ".join(f"Sentence number {i} has some words in it" for i in range(150))
    docs = spark.createDataFrame([("s", "short"), ("m", text[:6000]), ("l", text * 4), ("e", " ")], "path string, content string")
    by = {}
    for partitions in (1, 4):
        rows = ts.chunk(docs.repartition(partitions)).orderBy("path", "chunk_index").collect()
        by[partitions] = rows
    assert by[1] == by[4]
    counts = {p: len(list(g)) for p, g in itertools.groupby(by[1], key=lambda r: r.path)}
    assert counts["s"] == 1 and 4 <= counts["m"] <= 8 and counts["l"] > 8 and "e" not in counts
    assert all(len(r.text) <= 1210 for r in by[1])
    for path, spans in itertools.groupby(by[1], key=lambda r: r.path):
        reached = 0
        for r in spans:
            assert r.start <= reached < r.end
            reached = r.end
    assert max(r.end for r in by[1] if r.path == "l") == len(" ".join((text * 4).split()))


def test_embed_reports_errors(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[1.0, 2.0] for _ in texts]

    docs = spark.createDataFrame([("ok", "fine"), ("no", "bad text"), ("none", "")], "path string, content string")
    got = {r.path: (r.embedding, r.error) for r in ts.embed(docs, picky, created_at=F.lit("t")).collect()}
    assert got["ok"] == ([1.0, 2.0], None) and got["no"] == (None, "no") and got["none"][0] is None and "empty" in got["none"][1]


def test_blocks(spark):
    text = "# T\ntext\nmore\n\n- [ ] a\n- [x] b\n\n1. x\n* y\n> [!todo] L\n> body\n```py\ncode\n```\n|a|b|\n|-|-|\n|1|2|\n***"
    rows = ts.blocks(spark.createDataFrame([("p", text)], "path string, content string")).collect()
    assert [r.type for r in rows] == ["heading", "paragraph", "todo", "list", "callout", "code", "table", "rule"]
    assert rows[4].title == "L" and rows[4].text == "body" and rows[5].text == "code" and rows[5].language == "py"


def test_facts_and_answers(spark):
    docs = spark.createDataFrame([("a.md", "My wedding day is on June 12, 2027. My role is backend engineer\nDeadline: Friday"), ("b.md", "wedding day xxxx")], "path string, content string")
    facts = fa.extract_facts(docs)
    got = {(r.path, r.subject, r.value, r.kind, r.confidence) for r in facts.collect()}
    assert ("a.md", "wedding day", "June 12, 2027", "date", 0.96) in got
    assert ("a.md", "role", "backend engineer", "attribute", 0.76) in got
    assert ("a.md", "Deadline", "Friday", "date", 0.9) in got
    assert ("b.md", "wedding day", "xxxx", "attribute", 0.7) in got
    asked = spark.createDataFrame([("1", "When is my wedding?"), ("2", "How is the plan?")], "query_id string, query string")
    answers = fa.answer_from_facts(asked, facts).collect()
    assert [(r.query_id, r.answer) for r in answers] == [("1", "wedding day is June 12, 2027.")]


def test_links(spark):
    docs = spark.createDataFrame(
        [("a/one.md", "[[Two|second]] [x](two.md) [[gone]] [[dup]] [w](https://x.y)"), ("b/two.md", "one is named One here"), ("c/dup.md", ""), ("d/dup.md", "")],
        "path string, content string",
    )
    broken = {(r.target, r.reason) for r in lk.broken_references(docs, docs).collect()}
    assert broken == {("gone", "missing"), ("dup", "ambiguous")}
    fixed = lk.repair_references(docs, docs).collect()
    assert fixed[0].content.startswith("[[b/two.md|second]] [x](../b/two.md) [[gone]]") and fixed[0].replaced == 2
    backlinks = [(r.path, r.source) for r in lk.mention_backlinks(docs).collect()]
    assert ("a/one.md", "b/two.md") in backlinks and ("b/two.md", "a/one.md") in backlinks


def test_model_matches(spark):
    cases = [("m", "M:latest", True), ("m", "m@sha256:ab12", True), ("m:1", "m", False), ("", "m", False), ("m", "mm", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean").select(mt.model_matches("a", "b").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_number_rows(spark):
    rows = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v int")
    assert [(r.v, r.position) for r in number_rows(rows, "v", partitions=6).orderBy("v").collect()] == [(i, i) for i in range(50)]


def test_apply_plan(spark):
    corpus = spark.createDataFrame([("a/x.md", "X"), ("b/x.md", "Y"), ("c/t.md", "T"), ("c/t-2.md", "old"), ("d/s.md", "S"), ("e/z.md", "Z")], "path string, content string")
    ops = [
        (0, "move", "a/x.md", "c/t.md", None), (1, "move", "b/x.md", "c/t.md", None), (2, "merge", "d/s.md", "c/t.md", None), (3, "delete", "e/z.md", None, None),
        (4, "delete", "c/t-2.md", None, None),
    ]
    plan = spark.createDataFrame(ops, "op_id bigint, type string, source_path string, target_path string, issue_type string").withColumn("reason", F.lit("r"))
    after, trash, undo = pl.apply_plan(corpus, plan, plan.filter("op_id < 4").select("op_id"), "r1")
    assert {r.path: r.content for r in after.collect()} == {"c/t.md": "T\n\n---\n\nS", "c/t-2.md": "old", "c/t-3.md": "X", "c/t-4.md": "Y"}
    assert {r.trash_path for r in trash.collect()} == {"Trash/r1/s.md", "Trash/r1/z.md"}
    assert undo.count() == 4


def test_sources(spark, tmp_path):
    from corpusloom.sources import embeddings as se
    from corpusloom.sources import files as sf
    from corpusloom.sources import tables as st

    root = tmp_path / "vault"
    (root / "sub dir").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "a.md").write_text("héllo\n")
    (root / ".hidden" / "b.md").write_text("no")
    (root / "index.json").write_text("{}")
    (root / "bin.dat").write_bytes(b"\x00\x01abc")
    (root / "sub dir" / "c+d.txt").write_bytes(b"ok \xff")
    (root / "t.csv").write_text("a,b\n1,2")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide10.xml", "<a>ten</a>")
        z.writestr("ppt/slides/slide2.xml", "<a>two &amp; more</a>")
        z.writestr("ppt/slides/_rels/slide2.xml.rels", "<r/>")
    (root / "p.pptx").write_bytes(data.getvalue())
    (root / "broken.docx").write_bytes(b"nope")
    good, bad = sf.read_corpus(spark, str(root))
    texts = {r.path: (r.kind, r.content) for r in good.collect()}
    assert texts == {"a.md": ("text", "héllo\n"), "sub dir/c+d.txt": ("text", "ok �"), "t.csv": ("csv", "a,b\n1,2"), "p.pptx": ("pptx", "ten\ntwo & more")}
    assert {r.path for r in bad.collect()} == {"bin.dat", "broken.docx"}

    store = tmp_path / "emb"
    (store / "x").mkdir(parents=True)
    (store / "x" / "n.json").write_text(json.dumps({"embedding": [1, 2], "model": "m"}))
    (store / "o.json").write_text(json.dumps({"note_path": "/deep/o.pdf", "embedding": [1, "x", None], "chunks": [{"excerpt": " ", "embedding": [3]}]}))
    (store / "e.json").write_text(json.dumps({"note_path": "none.md"}))
    (store / "bad.json").write_text("{oops")
    index = {r.path: (r.embedding, r.chunks) for r in se.load_vector_index(spark, str(store)).collect()}
    assert set(index) == {"x/n.md", "deep/o.pdf"} and index["deep/o.pdf"][0] == [1.0, 0.0, 0.0] and index["deep/o.pdf"][1][0].excerpt is None
    with pytest.raises(Exception):
        se.read_embeddings(spark, str(store)).collect()

    empty = st.load_table(spark, str(tmp_path), "preferences")
    assert empty.count() == 0
    st.save_table(spark.createDataFrame([("k", "a", "", 1)], "kind string, key string, inner_key string, n bigint"), str(tmp_path), "preferences")
    assert st.load_table(spark, str(tmp_path), "preferences").count() == 1


def test_streams(spark, tmp_path):
    from corpusloom.streaming import activity, changes

    base = "2024-01-01 00:00:"
    rows = [("a", "v1", "normal", base + "00.0"), ("a", "v2", "high", base + "01.0"), ("b", "w", "normal", base + "00.5"), ("a", "v3", "normal", base + "20.0"), ("c", "end", "normal", base + "59.0")]
    src = tmp_path / "src"
    spark.createDataFrame(rows, "path string, content string, priority string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("path string, content string, priority string, ts timestamp").json(str(src))
    handed = []
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    query = changes.process_batches(changes.settled_changes(stream), store, check, lambda df, i: handed.extend((r.path, r.content, r.priority) for r in df.collect()))
    query.awaitTermination(90)
    assert sorted(handed) == [("a", "v3", "normal"), ("b", "w", "normal")]
    typed = stream.select(F.lit(1).alias("user_id"), "ts", F.lit(30).alias("chars"))
    out = activity.activity_stream(typed).writeStream.format("memory").queryName("act").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(90)
    assert spark.table("act").count() > 0


def test_retry_gate(spark, tmp_path):
    from corpusloom.streaming import changes

    rows = [("a", "failed", "00:00:00"), ("a", "request", "00:00:30"), ("a", "request", "00:01:01"), ("b", "request", "00:00:10")]
    src = tmp_path / "gate"
    spark.createDataFrame([(p, k, f"2024-01-01 {t}") for p, k, t in rows], "path string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("path string, kind string, ts timestamp").json(str(src))
    q = changes.retry_gate(stream).writeStream.format("memory").queryName("gate").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted((r.path, str(r.ts)[14:19], r.accepted) for r in spark.table("gate").collect())
    assert got == [("a", "00:30", False), ("a", "01:01", True), ("b", "00:10", True)]


@pytest.mark.parametrize("partitions", [1, 4])
def test_ties_do_not_depend_on_partitions(spark, partitions):
    from corpusloom.operators import maintenance as mt
    from corpusloom.operators import vectors as vs
    from corpusloom.streaming import changes as ch

    rows = [("a.md", [float(i)], f"m{i % 3}", "2024", f"h{i}") for i in range(40)]
    records = spark.createDataFrame(rows, "path string, embedding array<double>, model string, created_at string, content_hash string").repartition(partitions, "content_hash")
    got = vs.latest_embeddings(records).first()
    assert (got.model, got.embedding) == ("m2", [38.0])
    assert mt.model_status(spark.createDataFrame([("a.md",)], "path string"), records, "m2").first().up_to_date == 1
    edits = spark.createDataFrame([("a.md", f"c{i:02d}", "normal", i % 2) for i in range(20)], "path string, content string, priority string, s int")
    edits = edits.selectExpr("path", "content", "priority", "timestamp_seconds(1700000000 + s) ts").repartition(partitions, "content")
    assert ch.settled_changes(edits).first().content == "c19"


def test_a_burst_ends_after_exactly_the_gap(spark):
    from corpusloom.streaming import changes as ch

    times = [0, 2_199_999, 4_399_999, 6_599_998, 8_799_999]  # microseconds; the second and the last step are 2.2 s or more
    edits = spark.createDataFrame([("a.md", f"c{t}", "normal", t) for t in times], "path string, content string, priority string, us long")
    got = ch.settled_changes(edits.selectExpr("path", "content", "priority", "timestamp_micros(1700000000000000 + us) ts")).orderBy("first_at").collect()
    assert [(r.content, r.edits) for r in got] == [("c2199999", 2), ("c6599998", 2), ("c8799999", 1)]


def test_every_document_is_a_note(spark, sf):
    from corpusloom.plans import fixtures as fx

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    notes = fx.notes(spark, sf)
    assert notes.count() == docs.count() + docs.filter("doc_id % 10 = 0").count()
    assert notes.select("path").distinct().count() == notes.select("doc_id").distinct().count() == notes.count()
    missing = docs.join(notes, F.contains(notes.content, docs.text) & (notes.doc_id == docs.doc_id), "left_anti")
    assert missing.isEmpty()


def test_checkpoint_folder_is_required_on_clusters():
    from types import SimpleNamespace

    from corpusloom.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_failing_chunks_are_halved_not_cut(spark):
    def short_only(texts):
        if any(len(t) > 3000 for t in texts):
            raise ValueError("too long")
        return [[float(len(t)), 1.0] for t in texts]

    chunks = spark.createDataFrame([("p", 0, 0, 8000, "x" * 8000), ("p", 1, 0, 5, "short")], ts.CHUNK_SCHEMA)
    got = {r.chunk_index: r for r in ts.embed_chunks(chunks, short_only).collect()}
    assert (got[0].parts, got[0].embedding, got[0].error) == (4, [2000.0, 1.0], None) and got[1].parts == 1


def test_ten_thousand_keyword_queries_equal_brute_force(spark):
    """Substrings, repeated tokens, phrases and ties, with cells of a few texts and all queries in several blocks."""
    from corpusloom.operators import scoring

    rng = random.Random(11)
    parts = ["pl", "an", "a", "bud", "get", "met", "rics", "é", "x1", "-"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    vocabulary = [word() for _ in range(60)]
    docs = [(f"f{i % 3}/{rng.choice(vocabulary)} {i:02d}.md", " ".join(rng.choices(vocabulary, k=8))) for i in range(45)]
    queries = [(i, " ".join(rng.choices(vocabulary + parts, k=rng.randint(1, 3)))) for i in range(10_000)]
    d = spark.createDataFrame(docs, "path string, content string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    got = {}
    asked = q.select("query_id", rt.search_tokens("query").alias("tokens"), F.lower(F.trim("query")).alias("phrase"))
    texts = d.select(F.col("path").alias("key"), F.lower(F.substring_index("path", "/", -1)).alias("name"), F.lower("path").alias("path"), F.lower("content").alias("content"))
    top = scoring.best_texts(asked, texts, rt.TOKEN_WEIGHTS, rt.PHRASE_WEIGHTS, 5, query_block_rows=3000, text_block_rows=20)
    for r in top.collect():
        got.setdefault(int(r.query_id), []).append((r["rank"], r.key, int(r.score)))
    lowered = [(p, p.split("/")[-1].lower(), p.lower(), c.lower()) for p, c in docs]
    for qid, query in queries:
        phrase, tokens = query.lower(), query.lower().split()
        scores = []
        for p, name, where, text in lowered:
            s = 120 * (phrase in name) + 60 * (phrase in where) + 40 * (phrase in text)
            s += sum(20 * (t in name) + 10 * (t in where) + 4 * (t in text) for t in tokens)
            if s:
                scores.append((-s, p))
        assert [(p, s) for _, p, s in sorted(got.get(qid, []))] == [(p, -s) for s, p in sorted(scores)[:5]], query


def shuffled(spark):
    """Bytes shuffled since the session began."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_keyword_search_shuffles_texts_once(spark):
    """Frequent short tokens are in nearly all words; neither words nor what they hold are shuffled, only the texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=9))
    docs = [(f"f/{i}.md", " ".join(word() for _ in range(400))) for i in range(500)]
    size = sum(len(c) for _, c in docs)
    d = spark.createDataFrame(docs, "path string, content string")
    q = spark.createDataFrame([(f"q{i}", f"{a} {b}") for i, (a, b) in enumerate(zip("abcdefgh", "hgfedcba"))], "query_id string, query string")
    before = shuffled(spark)
    hits = rt.with_snippets(rt.keyword_topk(q, d, 3), q, d).collect()
    assert len(hits) == 24 and shuffled(spark) - before < 1.5 * size


def test_bits_never_understate_how_alike_words_are(spark):
    """Also for words that share a bit, equal sets and empty ones: a pair that the bits rule out is no related pair."""
    from corpusloom.functions.duplicates import jaccard
    from corpusloom.operators import related as rl

    rng = random.Random(8)
    some = lambda n: sorted({rng.choice([rng.randrange(40), 64 * rng.randrange(9), rng.randrange(10**6)]) for _ in range(n)})
    rows = [(some(rng.randrange(30)), some(rng.randrange(60)), some(rng.randrange(5))) for _ in range(60)]
    docs = rl._signed(spark.createDataFrame(rows, "entity array<int>, keyword array<int>, title array<int>"))
    doc = F.struct(*docs.columns)
    pairs = docs.select(doc.alias("x")).crossJoin(docs.select(doc.alias("y")))
    for kind in rl.KINDS:
        most, exact = rl._most_alike(kind, "x", "y"), jaccard(f"x.{kind}", f"y.{kind}")
        got = pairs.select(F.sum((most < exact).cast("int")).alias("less"), F.avg(most).alias("most"), F.avg(exact).alias("exact")).first()
        assert got.less == 0 and got.most < 1


def brute_edges(docs, vectors):
    """The five best of all pairs of documents (path -> title words, keywords, entities) by the score's definition."""
    import numpy as np

    def jac(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a and b else 0.0

    out = {}
    for a, x in docs.items():
        scores = []
        for b, y in docs.items():
            if a == b:
                continue
            s = 0.0
            if a in vectors and b in vectors:
                u, v = np.array(vectors[a]), np.array(vectors[b])
                s = round(max(0.0, min(1.0, float(u @ v) / float(np.linalg.norm(u) * np.linalg.norm(v)))), 9)
            t, k, e = (jac(p, q) for p, q in zip(x, y))
            fa, fb = a.rpartition("/")[0], b.rpartition("/")[0]
            ta, tb = a.split("/"), b.split("/")
            top = len(ta) > 1 and len(tb) > 1 and ta[0] == tb[0]
            folder = fa != "" and fa == fb
            second = top and len(ta) > 2 and len(tb) > 2 and ta[1] == tb[1]
            total = min(1.0, 0.56 * s + 0.16 * k + 0.08 * t + 0.2 * e + (0.09 if folder else 0.05 if second else 0.02 if top else 0.0))
            strong = s >= 0.48 or e >= 0.22 or k >= 0.24 or t >= 0.38 or folder and (s >= 0.2 or e >= 0.14 or k >= 0.18)
            if not strong or (s < 0.12 and k < 0.12 and t < 0.18 and e < 0.12):
                total = 0.0
            elif top and not folder and s < 0.22 and e < 0.18 and k < 0.2:
                total = min(total, 0.26)
            if round(total, 9) >= 0.3:
                scores.append((-round(total, 9), b))
        out |= {(a, b): (rank, -s) for rank, (s, b) in enumerate(sorted(scores)[:5], 1)}
    return out


def test_related_edges_equal_all_pairs_and_updates_equal_recomputation(spark, monkeypatch):
    from corpusloom.operators import related as rl

    monkeypatch.setattr(rl, "WORD_BLOCK", 16)
    monkeypatch.setattr(rl, "VECTOR_BLOCK", 50)
    rng = random.Random(4)

    def sets(n, least, most):
        return ["all", *{f"w{int(rng.random() ** 2 * n)}" for _ in range(rng.randint(least, most))}]

    docs = {f"{'f/' * rng.randint(0, 1)}g{rng.randint(0, 2)}/{'h/' * rng.randint(0, 1)}d{i}": (sets(8, 0, 2), sets(30, 0, 12), sets(40, 0, 14)) for i in range(150)}
    docs |= {f"root{i}": ([], sets(9, 0, 6), []) for i in range(12)}
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    vectors = {p: [c + rng.gauss(0, 0.7) for c in rng.choice(centres)] for p in docs if rng.random() < 0.6}

    def frames(docs, vectors):
        rows = [(p, p, *x, p.rpartition("/")[0], p.split("/")[0] if "/" in p else "", p.split("/")[1] if p.count("/") > 1 else "") for p, x in docs.items()]
        f = spark.createDataFrame(rows, "path string, title string, title_tokens array<string>, keywords array<string>, entities array<string>, folder string, top string, second string")
        return f, spark.createDataFrame(list(vectors.items()), "path string, embedding array<double>")

    def got(edges):
        return {(r.source, r.target): (r["rank"], r.score) for r in edges.collect()}

    f, v = frames(docs, vectors)
    edges = rl.related_edges(f, v)
    want = brute_edges(docs, vectors)
    assert got(edges) == want and len(want) > 200
    stored = spark.createDataFrame(edges.collect(), edges.schema)
    later, moved = dict(docs), dict(vectors)
    gone = sorted(docs)[::17]
    for p in gone:
        later.pop(p), moved.pop(p, None)
    edited = sorted(later)[::13]
    for p in edited:
        later[p] = (sets(8, 0, 2), sets(30, 0, 12), sets(40, 0, 14))
        moved[p] = [c + rng.gauss(0, 0.7) for c in rng.choice(centres)]
    added = {f"g1/new{i}": (sets(8, 0, 2), sets(30, 2, 12), sets(40, 2, 14)) for i in range(5)}
    later |= added
    f, v = frames(later, moved)
    changed = spark.createDataFrame([(p,) for p in [*edited, *added]], "path string")
    assert got(rl.update_related(stored, changed, f, v)) == brute_edges(later, moved)


@pytest.mark.parametrize("marked", [1, 10**6])
def test_tiles_score_what_the_word_join_scores(spark, monkeypatch, marked):
    """Common words counted along their documents and marked; vectors of two sizes; a tile hands on few rows."""
    from corpusloom.operators import related as rl

    monkeypatch.setattr(rl, "WORD_BLOCK", 16)
    monkeypatch.setattr(rl, "TILE_CELLS", 300)
    monkeypatch.setattr(rl, "MARKED_SHARE", marked)
    rng = random.Random(11)
    some = lambda n, m: sorted({f"w{int(rng.random() ** 2 * n)}" for _ in range(rng.randint(0, m))})
    paths = [f"{'f/' * rng.randint(0, 1)}g{rng.randint(0, 1)}/{'h/' * rng.randint(0, 1)}d{i}" for i in range(70)] + [f"root{i}" for i in range(8)]
    rows = [(p, some(8, 3), some(30, 12), some(40, 14), p.rpartition("/")[0], p.split("/")[0] if "/" in p else "", p.split("/")[1] if p.count("/") > 1 else "") for p in paths]
    f = spark.createDataFrame(rows, "path string, title_tokens array<string>, keywords array<string>, entities array<string>, folder string, top string, second string")
    v = spark.createDataFrame([(p, [rng.gauss(0.4, 1) for _ in range(rng.choice([3, 5]))]) for p in paths if rng.random() < 0.7], "path string, embedding array<double>")

    def got(scored):
        return sorted((r.source, r.target, *(round(r[s], 9) for s in (*rl.SIGNALS, "score"))) for r in scored.collect())

    def joined(changed=None):
        return rl._both_ways(rl.score_pairs(rl.related_pairs(f, v, changed), f, v).where(F.col("score") >= rl.MIN_SCORE))

    want = got(joined())
    assert got(rl.tiled_scores(f, v)) == want and len(want) > 300
    changed = spark.createDataFrame([(p,) for p in paths[::9]], "path string")
    assert got(rl.tiled_scores(f, v, changed)) == got(joined(changed))
    assert not rl._words_are_rare(f)
    few = rl.scored_pairs(f, v, limit=1)
    assert few.groupBy("source").count().agg(F.max("count")).first()[0] <= 5  # one from each of five blocks
    assert got(rl.top_edges(few, 1).drop("rank")) == got(rl.top_edges(joined(), 1).drop("rank"))


def test_tiles_compare_only_documents_with_vectors_one_by_one(monkeypatch):
    """Other pairs meet on words: near copies in and across folders, titles alike, no words at all, pairs of old ends."""
    import pyarrow as pa

    from corpusloom.operators import related as rl

    rng = random.Random(21)
    word = lambda: f"w{int(rng.random() ** 2 * 900)}"
    unit = lambda n: [x / n**0.5 for x in rng.choices([-1.0, 1.0], k=n)]
    docs = []
    for i in range(900):
        if docs and rng.random() < 0.5:
            keep = rng.choice([0.6, 0.8, 0.95])
            keywords, entities = ([w if rng.random() < keep else word() for w in c] for c in rng.choice(docs)[1:3])
        else:
            keywords, entities = [word() for _ in range(rng.randint(0, 22))], [word() for _ in range(rng.choice([0, 2, 9, 60]))]
        title = ["doc", *([rng.choice(["copy", "final"])] if rng.random() < 0.3 else []), f"n{rng.randint(0, 400)}"]
        folder = rng.choice(["", "a/x", "a/x/y", "a/z", "b", "b/c"])
        has = rng.random()
        docs.append((title if has < 0.9 else [], list({*keywords}), list({*entities}), folder, unit(4 if has < 0.1 else 5) if has < 0.25 else None))
    parts = lambda folder: [*f"{folder}/d".split("/")[:2], ""]
    tile = pa.table({
        "path": [f"{d[3]}/d{n:04d}" for n, d in enumerate(docs)], "title_tokens": [d[0] for d in docs], "keywords": [d[1] for d in docs],
        "entities": [d[2] for d in docs], "folder": [d[3] for d in docs], "top": [parts(d[3])[0] if d[3] else "" for d in docs],
        "second": [parts(d[3])[1] if d[3].count("/") else "" for d in docs], "unit": pa.array([d[4] for d in docs], pa.list_(pa.float64())),
        "old": [n % 7 == 0 for n in range(len(docs))], "block": pa.array([n % 2 for n in range(len(docs))], pa.int32()),
    })
    looked, real = [], rl._Tile.scores
    monkeypatch.setattr(rl._Tile, "scores", lambda self, left, fits: looked.append(len(left) * len(self.right)) or real(self, left, fits))
    monkeypatch.setattr(rl, "MEETINGS", 500)

    def got(i, j):
        looked.clear()
        own = tile.append_column("i", pa.array([i] * len(docs), pa.int32())).append_column("j", pa.array([j] * len(docs), pa.int32()))
        return sorted(map(str, rl._tile_edges(own, None).to_pylist())), sum(looked)

    few = {(i, j): got(i, j) for i, j in ((0, 0), (0, 1))}
    monkeypatch.setattr(rl._Meetings, "meet", lambda self, left, right: 1 << 60)
    for (i, j), (edges, pairs) in few.items():
        every, all_pairs = got(i, j)
        assert edges == every and len(edges) == len(set(edges)) > 200
        assert pairs < all_pairs / 10


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_pivot_search_equals_brute_force(spark, kind, monkeypatch):
    """Many cells of few vectors, ties, a direction that is missing, repeated paths and a second dimension."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 10))
    rows = []
    for i in range(400):
        v = rng.normal(size=10) if kind == "uniform" else centres[i % 12] + 0.1 * rng.normal(size=10)
        rows.append((f"p{i % 350:03d}", int(i >= 350), None if i < 350 else f"chunk {i}", v.tolist()))
    rows += [("p001", 5, "again", rows[1][3]), ("twin", -1, None, rows[2][3]), ("zero", -1, None, [0.0] * 10)]
    rows += [(f"s{i}", -1, None, rng.normal(size=3).tolist()) for i in range(5)]
    index = spark.createDataFrame(rows, "path string, chunk_index int, excerpt string, embedding array<double>").repartition(4)
    asked = [(f"p{i:03d}", rows[i][3]) for i in range(0, 350, 7)] + [("none", [0.0] * 10), ("s0", rows[-5][3]), ("odd", [1.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    visited = []
    real = vx._visits
    monkeypatch.setattr(vx, "_visits", lambda *a: visited.append(real(*a)) or visited[-1])
    for k, least, alone in [(3, 0.0, False), (8, 0.3, True), (1000, -1.0, False)]:
        got = {}
        for r in vx.pivot_topk(queries, index, k, least, alone, block_rows=16, cell_rows=20).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.path, round(r.similarity, 7), r.excerpt))
        for qid, q in asked:
            best = {}
            for path, chunk, excerpt, v in rows:
                if len(v) == len(q) and not (alone and path == qid):
                    norm = np.linalg.norm(q) * np.linalg.norm(v)
                    s = round(float(np.dot(q, v) / norm), 9) if norm else 0.0
                    best[path] = max(best.get(path, (-2.0, 0, None)), (s, -chunk, excerpt), key=lambda x: x[:2])
            want = sorted((-s, p, e) for p, (s, _, e) in best.items() if s >= least)[:k]
            assert [(p, s, e) for _, p, s, e in sorted(got.get(qid, []))] == [(p, round(-s, 7), e) for s, p, e in want], (qid, k)
    if kind == "clustered":  # most cells are left out
        assert visited[1].count() < 0.5 * len(asked) * 20


def test_vectors_go_to_a_few_cells(spark, monkeypatch):
    """Uniform vectors, of which no cell can be left out: what moves grows with the vectors, and a tile gives one row for each query."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 8))
    index = spark.createDataFrame([(f"p{i:04d}", v.tolist()) for i, v in enumerate(vectors)], "path string, embedding array<double>")
    visited, tiles = [], []
    visits, search = vx._visits, vx._search
    monkeypatch.setattr(vx, "_visits", lambda *a: visited.append(visits(*a)) or visited[-1])
    monkeypatch.setattr(vx, "_search", lambda *a: tiles.append(search(*a)) or tiles[-1])
    queries = index.select(F.col("path").alias("query_id"), "embedding")
    found = vx.pivot_topk(queries, vx.index_vectors(index), 4, 0.0, True, cell_rows=10).collect()
    n = [v.count() for v in visited]
    assert n[0] == 1500 and n[1] <= 1500 * (vx.CELLS - 1)
    assert [t.count() for t in tiles][0] == 1500 and tiles[1].count() <= n[1]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = {(int(r.query_id[1:]), r["rank"]): int(r.path[1:]) for r in found}
    want = np.argsort(-sims, axis=1)[:, :4]
    assert len(found) == 6000 and all(got[i, n + 1] == want[i, n] for i in range(1500) for n in range(4))


def test_links_are_cut_out_of_a_text_once(spark):
    """Each kind's pattern goes through the text once; target and label come from the link."""
    d = spark.createDataFrame([("a.md", "[[x#y| l ]] [[ z ]] ![p](q r) [w](https://e.f) [[[k]] [](e) [h](#t) [[b|]]"), ("b.md", None)], "path string, content string")
    links = lk.extract_links(d)
    got = sorted((r.kind, r.nth, r.full, r.target, r.label) for r in links.collect())
    assert got == [
        ("markdown", 0, "![p](q r)", "q r", "![p]"), ("markdown", 2, "[](e)", "e", "[]"),
        ("wiki", 0, "[[x#y| l ]]", "x#y", "l"), ("wiki", 1, "[[ z ]]", "z", ""), ("wiki", 2, "[[[k]]", "[k", ""),
    ]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_documents_of_one_path_try_their_own_links_only(spark):
    """Many documents of one path: each has its own link replaced, and none is compared with the links of the others."""
    n = 300
    files = spark.createDataFrame([(f"deep/Note {i}.md",) for i in range(n)], "path string")
    d = spark.createDataFrame([("a/index.md", f"see [[note {i}]] and [[note {i}|again]] or [[gone]]") for i in range(n)], "path string, content string")
    fixed = lk.repair_references(d, files.union(d.select("path")))
    got = sorted(r.content for r in fixed.collect())
    assert got == sorted(f"see [[deep/Note {i}.md]] and [[deep/Note {i}.md|again]] or [[gone]]" for i in range(n))
    assert {r.replaced for r in fixed.select("replaced").collect()} == {2 * n}
    plan = fixed._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(array_sort(array_distinct(concat(regexp_extract_all" in plan


def test_mentions_equal_a_scan_of_all_texts(spark):
    """Titles of several words, with signs around and between them, that overlap, repeat and occur everywhere."""
    import re

    rng = random.Random(12)
    names = ["Plan", "the plan", "Plan B", "plan b2", "(draft)", "x-ray", "a_b", "v1.2 notes", "+1", "日本", "plan  b", "notes (old)", "the"]
    pieces = ["plan", "b", "the", "(draft)", "x-ray", "x ray", "xx-ray", "a_b", "v1.2", "notes", "(old)", "+1", "é", "plan  b", "\n", ".", "PLAN B", "日本", "draft"]
    docs = [(f"f{i % 4}/{names[i % len(names)]}.md", " ".join(rng.choices(pieces, k=rng.randint(0, 14))) + rng.choice(["", ")", "("])) for i in range(52)]
    d = spark.createDataFrame(docs, "path string, content string")
    got = {(r.path, r.source): (r.score, r["rank"]) for r in lk.mention_backlinks(d, 6).collect()}
    want = {}
    for path, _ in docs:
        title = path.split("/")[1][:-3].strip().lower()
        if len(title) < 2 or not re.search("[a-z0-9_]", title):
            continue
        scores = []
        for source, content in docs:
            text, name, where = content.lower(), source.split("/")[1].lower(), source.lower()
            if source != path and re.search(r"(?<![A-Za-z0-9_])" + re.escape(title) + r"(?![A-Za-z0-9_])", text):
                count = sum(20 * (t in name) + 10 * (t in where) + 4 * (t in text) for t in title.split())
                scores.append((-(120 * (title in name) + 60 * (title in where) + 40 + count), source))
        want |= {(path, source): (-s, rank) for rank, (s, source) in enumerate(sorted(scores)[:6], 1)}
    assert got == want and len(want) > 100


def _stream(spark, frame, checkpoint, name):
    """Run what is there to its end and return the rows that the sink holds."""
    out = frame.writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{checkpoint}-out")


def test_keyed_streams_go_on_after_a_restart(spark, tmp_path):
    import json

    from corpusloom.streaming import keyed

    for key, value in keyed.STATE_STORE.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        src = tmp_path / "in"
        src.mkdir()
        at = lambda s: f"2024-01-01 00:{int(s) // 60:02d}:{s % 60:06.3f}"

        def feed(n, rows):
            (src / f"{n}.json").write_text("".join(json.dumps({"path": p, "content": c, "priority": q, "ts": at(t), "user_id": u}) + "\n" for p, c, q, t, u in rows))

        stream = spark.readStream.schema("path string, content string, priority string, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).json(str(src))
        feed(1, [("a", "one", "normal", 2.0, 1), ("a", "two", "high", 1.0, 1), ("b", "x", "normal", 1.0, 2), ("a", "three", "normal", 10.0, 1)])
        changed = lambda: _stream(spark, keyed.changed_bursts(stream), str(tmp_path / "changed"), "c")
        idle = lambda: _stream(spark, keyed.idle_users(stream), str(tmp_path / "idle"), "i")
        changed(), idle()
        feed(2, [("a", "three again", "normal", 9.0, 1), ("b", "x", "normal", 40.0, 2), ("c", "late", "normal", 70.0, 3)])  # the first row joins a burst
        changed(), idle()
        feed(3, [("d", "end", "normal", 200.0, 4)])
        changed(), idle()
        feed(4, [("d", "end", "normal", 300.0, 4)])
        rows = sorted((r.path, r.content, r.edits, r.priority) for r in changed().collect())
        assert rows == [("a", "one", 2, "high"), ("a", "three", 2, "normal"), ("b", "x", 1, "normal"), ("c", "late", 1, "normal"), ("d", "end", 1, "normal")][: len(rows)]
        assert len(rows) >= 4 and [r for r in rows if r[0] == "b"] == [("b", "x", 1, "normal")]  # the second burst of b changed nothing
        stops = sorted((r.user_id, r.last_at.second + 60 * r.last_at.minute) for r in idle().collect())
        assert stops[:5] == [(1, 2), (1, 10), (2, 1), (2, 40), (3, 70)] and len(stops) == len(set(stops))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_record_log_merges_when_read(spark, tmp_path):
    from corpusloom.sources.record_log import RecordLog

    log = RecordLog(spark, str(tmp_path / "log"), "path string, model string, embedding array<double>", buckets=8)
    assert log.read().count() == 0 and log.versions() == []
    rng, want, snapshots = random.Random(5), {}, {}

    def frame(rows):
        return spark.createDataFrame(rows, log.schema)

    def check():
        got = [(r.path, r.model, tuple(r.embedding)) for r in log.read().collect()]
        assert sorted(got) == sorted((p, m, tuple(v)) for p, (m, v) in want.items())

    for step in range(8):
        keys = [f"p{rng.randrange(40)}" for _ in range(rng.choice([3, 25]))]
        if step % 3 == 2:
            log.delete(spark.createDataFrame([(k,) for k in keys], "path string"))
            for k in keys:
                want.pop(k, None)
        else:
            rows = [(k, f"m{step}", [float(i)]) for i, k in enumerate(keys)]
            log.upsert(frame(rows))
            for k, m, v in rows:
                want[k] = max(want[k], (m, v)) if want.get(k, ("", []))[0] == m else (m, v)
        snapshots[log.versions()[-1]] = dict(want)
        check()
        if step == 4:
            before = {r.folder for r in log._manifest(None)}
            log.compact()
            check()
            assert all(r.kind == "base" for r in log._manifest(None)) and not before & {r.folder for r in log._manifest(None)}
    # A change of one key rewrites one bucket; the others stay in their folder.
    log.compact()
    folders = {r.bucket: r.folder for r in log._manifest(None)}
    log.upsert(frame([("p1", "last", [1.0])]))
    want["p1"] = ("last", [1.0])
    log.compact()
    after = {r.bucket: r.folder for r in log._manifest(None)}
    assert sum(folders.get(b) != f for b, f in after.items()) == 1
    check()
    # A write that fails leaves the snapshot; so does a manifest without its end mark.
    version = log.versions()[-1]
    with pytest.raises(Exception):
        log.upsert(frame([("p2", "bad", [0.0])]).withColumn("model", F.raise_error(F.lit("broken")).cast("string")))
    (tmp_path / "log" / "manifests" / f"{version + 1:012d}").mkdir()
    assert log.versions()[-1] == version
    check()
    for old, state in snapshots.items():  # earlier snapshots stay readable
        assert {r.path for r in log.read(old).collect()} == set(state)
    assert log.vacuum() > 5 and log.versions() == [version]
    check()
    log.clear()
    assert log.read().count() == 0


def test_neighbours_are_searched_once_and_for_found_notes_only(spark, sf, monkeypatch):
    asked, search = [], vx.knn_candidates

    def counted(sources, index, *limits):
        asked.append((sources.count(), index.count()))
        return search(sources, index, *limits)

    monkeypatch.setattr(vx, "knn_candidates", counted)
    queries_retrieval.assemble_context(spark, sf)
    assert len(asked) == 1
    queries_retrieval.route_questions(spark, sf)
    assert len(asked) == 2 and asked[1][0] < asked[1][1]


def test_strategies_go_through_the_texts_once(spark):
    """All strategies together, each as by itself; every text is read once."""
    read = spark.sparkContext.accumulator(0)

    def seen(content):
        read.add(1)
        return content

    rows = [(f"src1/en/n{i}.md", f"New/Deep/n{i}.md", f"due 2024-{1 + i % 12:02d}-05 {'x' * i}", "Work", "Data", f"Plan {i}") for i in range(9)]
    moves = spark.createDataFrame(rows, "current string, target string, content string, category string, subcategory string, plan_title string")
    moves = moves.withColumn("path", F.col("current")).withColumn("modified_at", F.lit(None).cast("timestamp"))
    known = spark.createDataFrame([("top", "work", "", 1)], "kind string, key string, inner_key string, n long")
    names = ["type", "timeline", "project", "meaning"]
    alone = {(r.path, n): (r.target, r.rationale) for n in names for r in pl.apply_strategy(moves, n, known).collect()}
    counted = moves.withColumn("content", F.udf(seen, "string")("content"))
    together = pl.apply_strategies(counted, names, known).collect()
    assert {(r.path, r.strategy): (r.target, r.rationale) for r in together} == alone and len(together) == 36
    assert ("Timeline/2024/01-Jan/n0.md", "timeline grouping") in alone.values()
    assert read.value == 9


def test_keywords_months_as_before(spark):
    """Stop words and fillers, words of the path, early words, ties; months found where no word touches them."""
    from corpusloom.functions import naming as nm
    from corpusloom.functions import text as tx

    texts = [
        ("Area/budget plan.md", "Über Budget-2024 note please alpha alpha beta API api", ["budget", "alpha", "api", "area"]),
        ("x.md", None, []), ("zeta.md", "", ["zeta"]), ("a.md", " ".join(["late"] * 3 + ["word"] * 40 + ["more"] * 5), ["word", "late", "more"]),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "path string, content string")
    assert [r[0] for r in df.select(nm.rank_keywords("content", "path")).collect()] == [t[2] for t in texts]
    dates = {"a2024-05 in 2023/7": (2023, 7), "x 12024-05 2024-13-01 may 3, 2022": (2022, 5), "2024-05-123": (2024, 5), "2024-123 Sept": (None, 9), "none": None, "_2024-05": None}
    got = spark.createDataFrame([(t,) for t in dates], "t string").select("t", tx.parse_month("t").alias("m")).collect()
    assert {r.t: r.m and tuple(r.m) for r in got} == dates


def test_duplicates_normalize_each_text_once(spark):
    """Roles come by themselves and say who takes part; only possible near copies are read again."""
    read = spark.sparkContext.accumulator(0)

    def seen(content):
        read.add(1)
        return content

    words = [f"word{i}" for i in range(40)]
    rows = [(f"a/plan {i} draft.md" if i % 4 == 0 else f"a/other{i}.md", " ".join([*words, f"more{i}"]), ["text-note", "image"][i % 2]) for i in range(12)]
    rows += [("a/plan 0.md", rows[0][1] + " end", "guide"), ("b/same.md", rows[1][1], "image"), ("b/left out.md", rows[1][1], None)]
    documents = spark.createDataFrame([r[:2] for r in rows], "path string, content string")
    roles = spark.createDataFrame([(p, role) for p, _, role in rows if role], "path string, file_role string")
    want = sorted(map(tuple, dd.detect_duplicates(documents.join(roles, "path")).collect()))
    found = dd.detect_duplicates(documents.withColumn("content", F.udf(seen, "string")("content")), roles)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 1
    assert not any("left out" in str(r) for r in want)
    # A filter on what comes of a text counts it again. Before, it was five times.
    assert read.value <= 4 * len(rows)


def test_make_up_of_texts(spark):
    from corpusloom.functions import text as tx

    texts = [None, "", "  Aé1  b﻿B2 \U0001f600?bb bb ", "KKel x　 y 12"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.extraction_features("t").alias("f")).collect()
    assert [(f.chars, f.words, *(round(x, 6) for x in f[2:])) if f.chars is not None else None for (f,) in got] == [
        None, (0, 0, 0.0, 0.0, 0.0, 0.0), (17, 2, 0.5, 0.583333, 0.166667, 0.25), (12, 1, 1.0, 0.625, 0.25, 0.125),
    ]
    assert sorted(spark.createDataFrame([("A1b c12 Éab-xyz'xyz  abc",)], "t string").select(du.word_set("t")).first()[0]) == ["a1b", "abc", "c12", "xyz"]


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_only_runs_that_may_be_titles_meet_them(spark, monkeypatch, bits):
    """The same mentions with few bits and many; a run that is no title is left out before it is shuffled."""
    monkeypatch.setattr(lk, "TITLE_BITS", bits)
    rows = [(f"a/plan {i}.md", f"see plan {(i + 1) % 30} and plan {(i + 1) % 30}, not plan {i}x") for i in range(30)]
    documents = spark.createDataFrame(rows, "path string, content string")
    found = {(r.path, r.source) for r in lk.mention_backlinks(documents).collect()}
    assert found == {(f"a/plan {(i + 1) % 30}.md", f"a/plan {i}.md") for i in range(30)}
    digest = lambda text: F.unhex(F.md5(F.lit(text).cast("binary")))
    titles = documents.select(F.regexp_extract("path", "(plan.*)[.]md", 1).alias("title")).select(F.unhex(F.md5(F.col("title").cast("binary"))).alias("digest"))
    every = lk._title_bits(titles)
    assert titles.where(lk._may_be_title(F.col("digest"), every)).count() == 30
    other = spark.range(1).select(*(lk._may_be_title(digest(f"other {i}"), every).alias(f"c{i}") for i in range(20))).first()
    assert sum(other) < 20 and (bits == 64 or not any(other))
