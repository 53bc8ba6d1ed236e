"""Quality rules: fixed base rules, then a decision list learnt by sequential covering.

Spark computes the features of every document in one pass and the labelled sample; the list is grown and pruned on that
bounded sample and comes out as ordered threshold conditions, applied to all documents as one conditional expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import spare

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
# Labelled documents that the list is learnt from, whatever the number of labels.
LABEL_SAMPLE = 40_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_distinct_words"]

# What the list may test: each a ratio of counts, so that long and short texts compare.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
}


# ---- features


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words that lie in a window of words found twice or more, and the number of distinct words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(words) <= window:
        return 0, len(number)
    names, width = ids, 1
    while width < window:  # name windows by pairs of names of shorter ones
        step = min(width, window - width)
        _, names = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)
        width += step
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum()), len(number)


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8; bytes.split splits at ASCII white space only."""
    words = text.split()
    joined = b"".join(words)
    continuation = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0))))
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    repeats, distinct = repeated_words(words)
    return (
        len(words), len(joined) - continuation, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats,
        len(lines), len(joined) - len(joined.translate(None, b"0123456789")),
        len(joined) - len(joined.translate(None, bytes(range(65, 91)))), distinct,
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS for each document; a null text has no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(text or b"") for text in batch.column(1).to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < min_words) | (100 * F.col(f"{prefix}n_repeat_words") > max_repeat_percent * words)


# ---- learning


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def holds(self, data: pd.DataFrame) -> np.ndarray:
        values = data[self.feature].to_numpy()
        return values >= self.threshold if self.above else values < self.threshold

    def column(self, prefix: str = "") -> Column:
        value = F.expr(_prefixed(FEATURES[self.feature], prefix))
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, data: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(data), bool)
    for test in rule:
        out &= test.holds(data)
    return out


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """What a test gains: the positives it keeps, times the bits by which their share grows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))))


def grow_rule(data: pd.DataFrame, target: np.ndarray) -> Rule:
    """Add the test of largest gain until only rows to reject are covered, or no test gains. Ties: the first feature."""
    rule: list[Test] = []
    inside = np.ones(len(data), bool)
    while (~target[inside]).any() and target[inside].any():
        goal, best = target[inside], (1e-9, None)
        for feature in FEATURES:
            values = data[feature].to_numpy()[inside]
            order = np.argsort(values, kind="stable")
            ordered, hits = values[order], goal[order]
            cuts = np.flatnonzero(np.diff(ordered) > 0) + 1
            if not len(cuts):
                continue
            below_p = np.cumsum(hits)[cuts - 1]
            below_n = cuts - below_p
            p0, n0 = int(goal.sum()), int((~goal).sum())
            middles = (ordered[cuts - 1] + ordered[cuts]) / 2
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                gains = _gain(p.astype(float), n.astype(float), p0, n0)
                at = int(np.argmax(gains))
                if gains[at] > best[0]:
                    best = (float(gains[at]), Test(feature, above, float(middles[at])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(data)
    return tuple(rule)


def _worth(rule: Rule, data: pd.DataFrame, target: np.ndarray) -> tuple[float, int]:
    inside = _covers(rule, data)
    hits, misses = int(target[inside].sum()), int((~target[inside]).sum())
    return ((hits - misses) / (hits + misses) if hits + misses else -1.0), hits


def prune_rule(rule: Rule, data: pd.DataFrame, target: np.ndarray) -> Rule:
    """Cut tests from the end where rows that the rule was not grown on say that it covers them no worse."""
    return max((rule[:n] for n in range(len(rule), 0, -1)), key=lambda r: (round(_worth(r, data, target)[0], 3), -len(r)))


def learn(sample: pd.DataFrame, min_precision: float = 0.95) -> list[Rule]:
    """Sequential covering: rules that reject, in order, each learnt on what the earlier ones left.

    `sample` has FEATURES, `quality` (0: reject) and `fold` (0, 1: grow; 2: prune). A rule counts if, on the rows kept
    for pruning, `min_precision` of what it rejects is to be rejected; the first that doesn't ends the list.
    """
    rules: list[Rule] = []
    rest = sample
    while True:
        grow, prune = rest[rest["fold"] < 2], rest[rest["fold"] == 2]
        target = grow["quality"].to_numpy() == 0
        if not target.any():
            return rules
        rule = grow_rule(grow, target)
        if not rule:
            return rules
        pruned = prune_rule(rule, prune, prune["quality"].to_numpy() == 0)
        worth, hits = _worth(pruned, prune, prune["quality"].to_numpy() == 0)
        if not hits or (worth + 1) / 2 < min_precision:
            return rules
        rules.append(pruned)
        rest = rest[~_covers(pruned, rest)]


def _prefixed(feature: str, prefix: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", rf"{prefix}\1", feature)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional expression: true where no rule rejects."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.column(prefix)
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = LABEL_SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """Features of at most `limit` labelled documents, drawn by a hash of the id. Of several labels the lowest counts, of
    several texts of one id the one of least counts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(11))
    drawn = marks.orderBy(order, "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")  # `limit` slim rows at most
    rows = features(labelled).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("x")).select("doc_id", "x.*").join(F.broadcast(drawn), "doc_id")
    return (
        rows.select("doc_id", "quality", F.pmod(order, F.lit(3)).alias("fold"), *(F.expr(c).alias(n) for n, c in FEATURES.items()))
        .toPandas().sort_values("doc_id", ignore_index=True)
    )


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LABEL_SAMPLE) -> DataFrame:
    """One row for each document: doc_id, COUNTS, base_failed, kept.

    kept is false where a base rule fails or the first rule of the learnt list that fits rejects. Null and empty texts
    have no words and fail. Without any labels only the base rules decide. Rows that repeat an id are judged each;
    other columns are ignored; an empty table gives no rows.
    """
    rules = learn(labelled_sample(docs, labels, limit, id_col, text_col))
    failed = base_failed()
    return features(docs, id_col, text_col).select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns; rows that repeat an id are judged each.

    The counts of a text are put beside its row, so nothing is shuffled.
    """
    rules = learn(labelled_sample(docs, labels, LABEL_SAMPLE, id_col, text_col))
    counts = spare("counts", docs)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(text or b"") for text in texts], columns=COUNTS)

    named = docs.withColumn(counts, counted(F.col(text_col).cast("binary")))
    keep = ~base_failed(prefix=f"{counts}.") & verdict(rules, f"{counts}.")
    return named.where(keep).select(*docs.columns)
