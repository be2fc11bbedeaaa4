"""Quality classifier (operator 7): a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of whole texts are Spark columns. From at most ``sample`` labelled rows small trees are boosted on the driver; every path of a
tree is a rule, a conjunction of comparisons of statistics; lasso logistic regression (proximal gradient with momentum)
weighs the rules and drops most. What is left becomes one expression, so that scoring runs in the JVM without Python.

Nulls: a null text counts as empty; its statistics are 0 and it is scored like any other row. Labels with a null id or
quality are not learned from; repeated labels of an id count by their mean. A null ``doc_id`` is only scored. Without
labels every score is 0.5. Repeated rows get equal scores; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder, spill

#: Rows to learn from, about and at most.
SAMPLE = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, by name; ratios of nothing are 0."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    chars = F.length(text).cast("double")
    words = F.filter(F.split(F.lower(text), "[ \n\t\r]+"), lambda w: w != "")
    n_words, lines = F.size(words).cast("double"), F.filter(F.split(text, "\n"), lambda w: w != "")
    n_lines = F.size(lines).cast("double")
    return {
        "chars": chars,
        "words": n_words,
        "word_chars": ratio(chars, n_words),
        "distinct_words": ratio(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "line_words": ratio(n_words, n_lines),
        "upper": ratio(count(r"\p{Lu}"), chars),
        "digits": ratio(count(r"\p{Nd}"), chars),
        "symbols": ratio(count(r"[#$%&*|<>{}\[\]=+~^@_\\/]"), chars),
        "ends": ratio(count(r"[.!?](?=\s|$)"), n_words),
        "marks": ratio(count(r"!"), n_words),
        "commas": ratio(count(r","), n_words),
        "bars": ratio(count(r"\|"), n_words),
        "other": ratio(count(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()-]"), chars),
    }


NAMES = ["chars", "words", "word_chars", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "symbols", "ends", "marks", "commas", "bars", "other"]


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at most or above, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, under, threshold in self.terms:
            out = out & (F.col(name) <= threshold if under else F.col(name) > threshold)
        return out

    def matches(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, under, threshold in self.terms:
            v = x[:, NAMES.index(name)]
            out &= v <= threshold if under else v > threshold
        return out


def grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, depth: int, least: int, terms: tuple, found: list[tuple]) -> None:
    """Least-squares splits of ``g``; every node below the root is a rule (and gets the mean of ``g`` there)."""
    if terms:
        found.append((terms, rows, g[rows].mean()))
    if depth == 0 or len(rows) < 2 * least:
        return
    best, total = (1e-9, None, 0.0), g[rows].sum()
    for j in range(x.shape[1]):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        v, left = x[order, j], np.cumsum(g[order])[:-1]
        n = np.arange(1, len(order))
        gain = left**2 / n + (total - left) ** 2 / (len(order) - n) - total**2 / len(order)
        gain[(v[1:] <= v[:-1]) | (n < least) | (len(order) - n < least)] = 0
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > best[0]:
            best = (gain[i], j, float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return
    _, j, threshold = best
    under = x[rows, j] <= threshold
    grow(x, g, rows[under], depth - 1, least, (*terms, (NAMES[j], True, threshold)), found)
    grow(x, g, rows[~under], depth - 1, least, (*terms, (NAMES[j], False, threshold)), found)


def rules_of(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    random, margin, out = np.random.default_rng(5), np.zeros(len(y)), {}
    for _ in range(trees):
        rows = np.sort(random.choice(len(y), min(len(y), max(50, len(y) // 2)), replace=False))
        found: list[tuple] = []
        grow(x, y - 1 / (1 + np.exp(-margin)), rows, depth, max(5, len(y) // 500), (), found)
        for terms, _, mean in found:
            rule = Rule(terms)
            out[rule] = None
            if len(terms) == max(len(t) for t, _, _ in found):
                margin += rate * 4 * mean * rule.matches(x)
    return list(out)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of least logistic loss plus ``penalty`` times the sum of absolute weights."""
    n, k = a.shape
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    rate = 4 / max(1.0, float(np.linalg.norm(a, 2) ** 2 / n) + 1)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - rate * (a.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, new_t = c - rate * error.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        """Probability of label 1, an expression over the columns of ``statistics``."""
        terms = [F.lit(self.bias), *(F.when(rule.column(), weight).otherwise(0.0) for rule, weight in self.rules)]
        while len(terms) > 1:  # a balanced sum: a chain of hundreds is too deep for the analyser
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2 :]
        return 1 / (1 + F.exp(-terms[0]))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Ensemble((), float(np.log(p / (1 - p))))
    rules = rules_of(x, y)
    a = np.array([r.matches(x) for r in rules], np.float64).T
    spread = np.maximum(a.std(0), 0.05)  # rules that hold for few rows must not be cheap
    w, b = lasso(a / spread, y, penalty)
    kept = [(r, float(v / s)) for r, v, s in zip(rules, w, spread, strict=True) if abs(v) > 1e-6]
    return Ensemble(tuple(kept), float(b))


def described(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = (remainder("doc_id") == 1) & F.col("doc_id").isNotNull()
    return texts.select("doc_id", held.alias("held_out"), *[c.alias(name) for name, c in statistics(F.col("text")).items()])


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Ensemble:
    """Learn from labels of documents whose crc32(doc_id as text) mod 3 is not 1, of which a hash of the id draws ``sample``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id") != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label).alias("y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n))))
    got = stats.join(drawn, "doc_id").select("doc_id", "y", *NAMES).toPandas().sort_values("doc_id")
    return fit(got[NAMES].to_numpy(np.float64), (got["y"].to_numpy() >= 0.5).astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` to ``(doc_id, held_out, score, predicted)``."""
    stats = spill(described(docs), "statistics")
    score = train(stats, labels).score()
    return stats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
