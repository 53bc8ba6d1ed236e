import random
from html.parser import HTMLParser

import pytest

from corpusloom.llm import pages

SCHEMA = "page_id long, url string, html string, text string, host int"


def one(html):
    return pages.page_text(pages.parse(html), None)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<body><nav><a href='/'>x</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "A & B\none two three\nfour"),
        ("<div class='sidebar-1'>s s s s</div><div class=content><p>long enough <b>text</p><form>f</form><script>'</p>'</script><p>more</div>", "long enough text\nmore"),
        ("<main><p>kept</p><div id=comments><p>a very long reader comment, longer than all of the text</p></div></main>", "kept"),
        ("<article><header><h1>T</h1></header><p>x &lt; y &#233; a<b>b</b>c</p><!-- > c --><ul><li>i<li>j</ul></article>", "T\nx < y é abc\ni\nj"),
        ("<header>h</header><p>body text only", "body text only"),
        ("1 < 2 and <unclosed", "1 < 2 and <unclosed"),
        ("", ""), ("<script>never ends", ""), ("<!-- open", ""), ("<div><div><div>", ""),
    ],
)
def test_one_page(html, text):
    assert one(html) == text


LONG = " ".join(f"Sentence {i} of the article." for i in range(12))
NAV = "<nav><a href='/'>menu</a></nav>"


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<body>{NAV}<div class='content no-sidebar'><p>{LONG}</p></div><footer>f</footer>", LONG),
        (f"<body>{NAV}<div id=content class=has-sidebar><p>{LONG}</p><div class=sidebar>side text</div></div>", LONG),
        (f"<body><article class='post widget'><p>{LONG}</p></article>", LONG),
        (f"<body><article class='post comments-open'><p>{LONG}</p></article><div class=comments><p>{LONG} {LONG}</p></div>", LONG),
        (f"<body>{NAV}<div class=wrap><div class=lead>{LONG}</div><div class=rest>{LONG} {LONG}</div></div>", f"{LONG}\n{LONG} {LONG}"),
        (f"<body>{NAV}<article><h1>Head</h1><div><div class=entry-content><p>{LONG}</p></div></div></article>", f"Head\n{LONG}"),
        (f"<body><article><div class=article-header><h1>Head</h1></div><p>{LONG}</p></article>", f"Head\n{LONG}"),
        (f"<body><div class=post><div class=post-header><h1>Head</h1></div><p>{LONG}</p></div>", f"Head\n{LONG}"),
        (f"<body><h1>Head</h1><div class=box><p>{LONG}</p></div>", f"Head\n{LONG}"),
        (f"<table><tr><td><a href=1>one</a> <a href=2>two</a></td><td><p>{LONG}</p></td></tr></table>", LONG),
        (f"<article><p>one <script>x</script>two<style>y</style> three<p>{LONG}</article>", f"one two three\n{LONG}"),
        (f"<div class='widget layout'><div class=widget>{LONG}</div><div class=sidebar>{LONG}</div><div class=main>{LONG} {LONG}</div></div>", f"{LONG} {LONG}"),
        (f"<div class=cookie-notice>{LONG}</div><ol class=comment-list><li><article class=comment>{LONG}</article></ol><main>{LONG}</main>", LONG),
    ],
)
def test_the_article_stays_whole(html, text):
    assert one(html) == text


class Tree(HTMLParser):
    """A well-formed page as nested lists, for the extraction below, which looks at whole subtrees again and again."""

    def __init__(self, html):
        super().__init__()
        self.root = self.at = {"tag": "html", "cls": "", "kids": [], "up": None}
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "cls": dict(attrs).get("class") or "", "kids": [], "up": self.at}
        self.at["kids"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def brute_text(html):
    root = Tree(html).root

    def nodes(n):
        return [n, *(x for k in n["kids"] if isinstance(k, dict) for x in nodes(k))]

    def above(n):
        return [n, *above(n["up"])] if n else []

    off = [n for n in nodes(root) if n["tag"] in ("nav", "footer")]

    def gone(n):
        return any(a in off for a in above(n))

    def size(n):
        return 0 if gone(n) else sum(size(k) if isinstance(k, dict) else len(k.strip()) for k in n["kids"])

    suspects = [n for n in nodes(root) if n["cls"] in ("sidebar", "comments", "widget") and not gone(n)]
    whole, sizes = size(root), {id(n): size(n) for n in nodes(root)}
    for n in suspects:
        if gone(n):
            continue
        others = [m for m in suspects if n not in above(m) and m not in above(n)]
        outer = [m for m in others if not any(o in above(m) for o in others if o is not m)]
        rest = whole - sizes[id(n)] - sum(sizes[id(m)] for m in outer)
        if rest >= 0.15 * whole or (n["cls"] == "comments" and rest > 0):
            off.append(n)
    fit = [n for n in nodes(root) if n["tag"] in ("div", "article", "section", "body") and not gone(n) and whole and size(n) >= 0.85 * size(root)]
    if not fit:
        return None
    best = max(fit, key=lambda n: len(above(n)))
    articles = [a for a in above(best) if a["tag"] == "article"]
    best = articles[-1] if articles else best
    heads = [n for n in nodes(root) if n["tag"] == "h1" and not gone(n)]
    own = any(best in above(h) for h in heads)
    return "\n".join(
        k.strip() for n in nodes(root) if not gone(n) and (best in above(n) or (n["tag"] == "h1" and not own)) for k in n["kids"] if isinstance(k, str) and k.strip()
    )


def test_random_pages_equal_brute_force():
    draw = random.Random(6)
    count = 0

    def part(depth):
        if depth == 0 or draw.random() < 0.35:
            tag = draw.choice(["p", "p", "p", "h1"])
            return f"<{tag}>{' '.join(['word'] * draw.randint(1, 30))}{draw.randint(0, 999)}</{tag}>"
        tag = draw.choice(["div", "div", "article", "section", "nav", "footer"])
        cls = draw.choice(["", "", " class='box'", " class='sidebar'", " class='comments'", " class='widget'"])
        return f"<{tag}{cls}>{''.join(part(depth - 1) for _ in range(draw.randint(1, 3)))}</{tag}>"

    for _ in range(1500):
        html = f"<body>{''.join(part(4) for _ in range(draw.randint(1, 3)))}</body>"
        page = pages.parse(html)
        scores = pages.container_scores(page)
        best = [i for i, e in enumerate(page.elements) if e.path == pages.best_path(scores)]
        if len(best) != 1:  # equal paths are one place
            continue
        count += 1
        assert pages.text_on(page, page.elements[best[0]].path) == brute_text(html), html
    assert count > 600


def test_consensus_wins(spark):
    normal = "<div class='box{n}'><p>{body}</p></div><div class='extra'><p>{other}</p></div>"
    rows = [(i, "https://H.example/x?u", normal.format(n=i, body="main text of the page " * 9, other="short"), "t", 1) for i in range(5)]
    rows.append((5, "https://h.example/y", normal.format(n=5, body="brief but main", other="an unusually long extra part " * 9), "t", 1))
    rows += [(6, None, None, "t", 1), (7, "no host", "<p>lone</p>", "t", 1), (5, "https://h.example/y", "", "t", 1), (None, "x://z", "<article>é</article>", "t", 1)]
    got = pages.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert "brief but main" in {r.text for r in got if r.page_id == 5}
    assert {r.page_id: r.text for r in got if r.page_id in (6, 7, None)} == {6: "", 7: "lone", None: "é"}
    assert pages.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages_lose_their_frame(spark, sf):
    import re

    table = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in table.collect()}
    for r in pages.main_texts(table).collect():
        article = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = [" ".join(pages.references.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_long_and_deep():
    assert len(one("<article>" + "<div>" * 3000 + "deep" + "<p>word &amp; </p>" * 20_000)) > 100_000
