"""Column functions on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import duplicates as du
from corpusloom.functions import intents as it
from corpusloom.functions import naming as nm
from corpusloom.functions import paths as pt
from corpusloom.functions import responses as rs
from corpusloom.functions import text as tx
from corpusloom.functions.vectors import cosine


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def fnv(text):
    h = 2166136261
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


@pytest.mark.parametrize("text", ["", "hello", "naïve ß", "a😀b", "line\nline"])
def test_content_hash(spark, text):
    assert one(spark, tx.content_hash("t"), t=text) == fnv(text)


def test_cosine(spark):
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, cosine(vec(1, 0), vec(1, 0))) == 1.0
    assert one(spark, cosine(vec(1, 0), vec(1, 0, 0))) == 0.0
    assert one(spark, cosine(vec(0, 0), vec(1, 0))) == 0.0
    assert math.isclose(one(spark, cosine(vec(1, 1), vec(1, 0))), math.sqrt(0.5))


@pytest.mark.parametrize(
    "path, indexable, readable, visual",
    [
        ("notes/a.md", True, True, False), ("/a/b.TXT", True, True, False), ("a/b.pdf", False, True, False), ("a.png", False, False, True),
        ("Trash/a.md", False, False, False), ("a/.git/b.md", False, False, False), ("index.json", False, False, False), ("README", True, True, False),
    ],
)
def test_scope(spark, path, indexable, readable, visual):
    got = spark.range(1).select(F.lit(path).alias("p")).select(pt.is_indexable("p").alias("i"), pt.is_document_readable("p").alias("r"), pt.is_visual("p").alias("v")).first()
    assert tuple(got) == (indexable, readable, visual)


def test_paths(spark):
    assert one(spark, pt.normalize_suggested_path(F.lit("notes/Work/Plan"), F.lit("x/old.md"))) == "Work/Plan.md"
    assert one(spark, pt.normalize_suggested_path(F.lit("Plan.md.md"), F.lit("x/old.md"))) == "Unsorted/Plan.md"
    assert one(spark, pt.normalize_suggested_path(F.lit(""), F.lit("x/old.md"))) == "Unsorted/old.md"
    assert one(spark, pt.relative_path(F.lit("a/b/c.md"), F.lit("a/d/e.md"))) == "../d/e.md"
    assert one(spark, pt.suggestion_level(F.lit("misc/a.md"), F.lit("Work/a.md"))) == "strong"
    assert one(spark, pt.suggestion_level(F.lit("Work/a.md"), F.lit("Home/a.md"))) == "recommended"
    assert one(spark, F.array_join(pt.candidate_paths(F.lit("notes/a.md")), ",")) == "notes/a.md,a.md"


CASES = [
    ("This agreement covers pay, duties and secrecy.", "contract_docs_examples/Reco Universal LLC Contract.docx", "contract", "Reco Universal Contract"),
    ("Marketing strategy presentation on channels and goals.", "work/marketing_strategy.pptx", "presentation", "Marketing Strategy Presentation"),
    ("Weekly sync presentation with owner updates.", "work/weekly_sync_deck.pptx", "presentation", "Weekly Sync Presentation"),
    ("Budget, monthly costs and revenue assumptions.", "finance/budget_2026.xlsx", "spreadsheet", "Budget Report"),
    ("KPI dashboard with conversion metrics and churn.", "work/reporting/kpi_dashboard.xlsx", "spreadsheet", "KPI Dashboard Metrics Report"),
    ("transaction export with ledger rows and bank statement fields", "finance/exports/bank_statement_export.csv", "spreadsheet", "Bank Statement Export"),
    ("Employee onboarding steps and setup tasks.", "work/Eccalon_Onboarding_Paperwork/Welcome Packet.docx", "document", "Employee Onboarding Guide"),
    ("Project proposal outlining scope and budget.", "work/project_proposal_draft.docx", "document", "Project Proposal"),
    ("Offer letter with pay and start date.", "Career/Offer Packet/CloudWave Inc Offer.pdf", "document", "Cloudwave Inc Offer Letter"),
    ("Monthly transactions and balances.", "JonathanHunter/bank_statement.pdf", "document", "Jonathanhunter Bank Statement"),
    ("", "Work/UI/system_design_architecture_screenshot.png", "image", "System Design Architecture Screenshot"),
    ("", "Work/Architecture/api_flow_diagram.png", "image", "API Flow Diagram"),
    ("", "Personal/Photos/morning_walk.jpg", "image", "Morning Walk Photo"),
    ("**Interviewer:** Hi, how's it going?\n**You:** Fine.", "interview_practice.md", "interview", "Interview Small Talk Practice"),
    ("Rewrite my resume to match the posting.", "career/resume_prompt.md", "prompt", "Resume Rewrite Prompt"),
    ("the github account shows daily activity", "a/b.md", "general", "GitHub Activity Plan"),
    ("- apples\n- pears", "home/shopping.md", "checklist", "Home Checklist"),
]


def test_naming_plan(spark):
    rows = spark.createDataFrame([(i, c, p) for i, (c, p, _, _) in enumerate(CASES)], "i int, content string, path string")
    got = {r.i: (r.kind, r.plan_title) for r in nm.naming_plan(rows).collect()}
    assert got == {i: (kind, title) for i, (_, _, kind, title) in enumerate(CASES)}


def test_titles(spark):
    fit = lambda t, k, p: one(spark, nm.normalize_title(F.lit(t), F.lit(k), F.lit(p)))
    assert fit("Marketing Strategy Slides", "presentation", "X Y") == "Marketing Strategy Presentation"
    assert fit("system design architecture", "image", "X Y") == "System Design Architecture Screenshot"
    assert fit("Yeah Just Know Really", "prompt", "Resume Rewrite Prompt") == "Resume Rewrite Prompt"
    weak = [one(spark, nm.needs_title_cleanup(F.lit(t))) for t in ("IMG_2455", "scan0001", "Untitled Copy", "bank_statement", "Project Proposal")]
    assert weak == [True, True, True, True, False]


@pytest.mark.parametrize(
    "raw, ok",
    [
        ('{"a": 1}', True), ('Text\n```json\n{"a": 1}\n```', True), ("{'a': 'b'}", True), ("// c\n{a: 1,};", True), ('"{\\"a\\": 1}"', True),
        ("[1, 2]", False), ("nothing", False), ("", False), ("{“a”: “b”}", True),
    ],
)
def test_recover_json(spark, raw, ok):
    assert (one(spark, rs.recover_json("r"), r=raw) is not None) == ok


def test_intents(spark):
    kind = lambda q: one(spark, it.retrieval_intent(F.lit(q)))
    assert [kind(q) for q in ("find the budget note", "why did it fail", "", "which folder holds it")] == ["lookup", "exploratory", "exploratory", "lookup"]
    fact = lambda q: one(spark, it.fact_intent(F.lit(q)))
    assert [fact(q) for q in ("When is the deadline?", "How is the deadline set?", "tell a story")] == ["direct", "contextual", "contextual"]
    assert one(spark, it.is_small_talk(F.lit("Good morning!"))) and not one(spark, it.is_small_talk(F.lit("hello world plan")))


def test_file_versions(spark):
    assert one(spark, du.normalized_stem(F.lit("a/ProjectPlan_v2 final copy.md"))) == "project plan"
    assert one(spark, du.noise_score(F.lit("a/Report copy (2).md"))) == 2
    assert one(spark, du.draft_state(F.lit("a/Plan draft.md"))) == "draft"


def test_text_features(spark):
    text = "Alice Smith met BOB on June 3, 2024. Deadline 2024-06-03! alice smith again"
    assert one(spark, F.array_join(tx.entities("t"), "|"), t=text) == "alice smith|deadline|bob|june 3, 2024|2024-06-03".replace("deadline|bob", "june|deadline|bob")
    assert one(spark, F.array_join(tx.top_keywords("t", 2), "|"), t="beta alpha beta gamma") == "beta|alpha"
    assert one(spark, tx.parse_month("t")["month"], t="minutes of 12 March") == 3
    assert one(spark, tx.strip_markup("t"), t="<p>a &lt; b</p>  <i>c") == "a < b c"
