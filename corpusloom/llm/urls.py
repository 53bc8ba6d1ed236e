"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, share one tree of contexts. A URL's score
is the difference of its log-likelihoods for each character. The difference at a character is that of the longest
context in the tree, which telescopes into a weight for every n-gram of the tree, so that scoring is one join with the
weights and one sum. The tree grows with the corpus and is joined by shuffles, hot n-grams by salt. Weights are whole micro-nats: sums don't depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved, spare, spread_join

ORDER = 5
MIN_COUNT = 5
SMOOTHING = 4.0
ALPHABET = 256
MICRO = 1_000_000
# Scores are calibrated on a histogram of this resolution, in nats a character.
BIN, BINS = 0.01, 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Seeds for URLs to reject: words of their hosts, between dots and hyphens. A parameter, as the rules are.
SEED_WORDS = ["casino", "bets", "betting", "poker", "spam", "porn", "xxx", "viagra", "pills", "warez", "malware", "phishing", "clickbait", "lottery"]

# (verdict, host, path)
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: list[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Of equally long ones the longer host wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1], r[2])):
        on_host = (F.col(host_col) == name) | F.col(host_col).endswith("." + name)
        out = F.when(on_host & F.col(path_col).startswith(start), F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(host_col: str = "host", path_col: str = "path") -> Column:
    """What the models read: host and path between two marks, every number as one 0."""
    plain = F.translate(F.concat(F.col(host_col), F.col(path_col)), UPPER, LOWER)
    return F.concat(F.lit("\x02"), F.regexp_replace(plain, r"[0-9]+", "0"), F.lit("\x03"))


def grams(text: Column, order: int = ORDER) -> Column:
    """All substrings of one to `order` characters, repeats included."""
    at = F.sequence(F.lit(1), F.length(text))
    sizes = F.array(*[F.lit(n) for n in range(1, order + 1)])
    return F.flatten(
        F.transform(sizes, lambda n: F.transform(F.filter(at, lambda i: i + n - 1 <= F.length(text)), lambda i: F.substring(text, i, n)))
    )


@dataclass(frozen=True)
class Model:
    weights: DataFrame  # gram, weight
    order: int


def train(labelled: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, smoothing: float = SMOOTHING) -> Model:
    """From text and accepted (boolean): the n-gram weights.

    Counts cover all rows. An n-gram enters the tree if it is frequent enough; as its suffixes and its context are at
    least as frequent and shorter, they enter before it.
    """
    found = labelled.select("accepted", F.explode(grams(F.col("text"), order)).alias("gram")).groupBy("gram").agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    tree = saved(found.where(F.col("a") + F.col("r") >= min_count), "grams")
    whole = tree.where(F.length("gram") == 1).agg(F.lit("").alias("gram"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    counts = tree.union(whole)
    n = F.length("gram")
    steps = tree.select("gram", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("end", F.expr("right(gram, k)"))
    steps = steps.withColumn("context", F.expr("left(end, k - 1)"))
    own = counts.select(F.col("gram").alias("end"), "a", "r")
    around = counts.select(F.col("gram").alias("context"), F.col("a").alias("ca"), F.col("r").alias("cr"))
    levels = spread_join(spread_join(steps, own, ["end"], "gram"), around, ["context"], "gram").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "a", "r", "ca", "cr"))).alias("levels"))

    def log_ratio(chain: str) -> str:  # each level is smoothed by the next shorter context, the first by equal chances
        chance = lambda c: f"aggregate({chain}, CAST({1 / ALPHABET} AS DOUBLE), (p, x) -> (x.{c} + {smoothing} * p) / (x.c{c} + {smoothing}))"
        return f"ln({chance('a')}) - ln({chance('r')})"

    delta = F.expr(f"({log_ratio('levels')}) - ({log_ratio('slice(levels, 1, size(levels) - 1)')})")
    weights = levels.select("gram", F.round(delta * MICRO).cast("long").alias("weight"))
    return Model(saved(weights, "url-model"), order)


def score(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add `score`: the log-likelihood of accepted less that of rejected URLs, in nats a character."""
    text, gram, by, n, own_weight, total = (spare(name, rows) for name in ("url_text", "gram", "by", "n", "weight", "total"))
    # Salts come from the rows' own values: a task that is computed again spreads its rows alike.
    keyed = rows.withColumns({text: F.col(text_col), by: F.xxhash64(*rows.columns)})
    texts = keyed.select(text).distinct()  # equal texts are scored once
    parts = texts.withColumn(gram, F.explode(grams(F.col(text), model.order))).groupBy(text, gram).agg(F.count(F.lit(1)).alias(n))
    parts = saved(parts.withColumn(by, F.xxhash64(text)), "url-grams")
    weights = model.weights.select(F.col("gram").alias(gram), F.col("weight").alias(own_weight))
    sums = spread_join(parts, weights, [gram], by).groupBy(text).agg(F.sum(F.col(n) * F.col(own_weight)).alias(total))
    # A text without a known n-gram has no sum. Texts with one come from the rows themselves, so every row finds its own.
    summed = spread_join(keyed, sums, [text], by, "left").withColumn(total, F.coalesce(total, F.lit(0)))
    return summed.select(*rows.columns, (F.col(total) / F.lit(float(MICRO)) / F.greatest(F.length(text_col), F.lit(1))).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """From score and accepted: the threshold of best balanced accuracy, below which a URL is rejected.

    Ties: the lowest one. Without both kinds nothing is rejected. The histogram has 2 * BINS + 1 bins.
    """
    bin_of = F.greatest(F.least(F.floor(F.col("score") / BIN), F.lit(BINS)), F.lit(-BINS)).cast("int")
    counts = {(r.bin, r.accepted): r["count"] for r in scored.groupBy(bin_of.alias("bin"), "accepted").count().collect()}
    good, bad = (sum(n for (_, kind), n in counts.items() if kind is want) for want in (True, False))
    if not good or not bad:
        return float("-inf")
    best, lost, caught = (1.0, float("-inf")), 0, 0
    for edge in range(-BINS, BINS + 1):
        worth = (good - lost) / good + caught / bad
        if worth > best[0] + 1e-12:
            best = (worth, edge * BIN)
        lost += counts.get((edge, True), 0)
        caught += counts.get((edge, False), 0)
    return best[1]


def label(seeds: list[str]) -> Column:
    """From host and rule: false for a host with a seed word, else what the rule says; null without host or rule."""
    seeded = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, seeds)).cast("array<string>"))
    return F.when(F.col("host") != "", F.when(seeded, False).otherwise(F.col("rule.verdict") == "allow"))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEED_WORDS, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict (allow or block), score.

    Labels come from the rules, and from seeds where these say that a host is to be rejected: a URL with a seed among the
    words of its host is a rejected one, any other that a rule decides is what the rule says, and the rest have no label.
    The models count the n-grams that four fifths of the labelled URLs, by a hash, hold MIN_COUNT times or more; the
    threshold is set on the rest. A rule comes before the models. Null URLs and those without :// have an empty host and
    path, and no part in training. Repeated rows are judged each, other columns are ignored, and an empty table gives no
    rows.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = split.withColumns({"rule": matched_rule(rules), "text": symbols()}).withColumns({
        "accepted": label(seeds), "fold": F.pmod(F.xxhash64("host", "path"), F.lit(5)),
    })
    model = train(rows.where("accepted is not null and fold > 0").select("text", "accepted"))
    scored = saved(score(rows, model), "url-scores")
    threshold = calibrate(scored.where("accepted is not null and fold = 0"))
    learnt = F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", learnt).alias("verdict"), "score")
