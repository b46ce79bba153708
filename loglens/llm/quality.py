"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path from a root is a conjunctive rule. Lasso
logistic regression weighs the rules, most weights becoming zero. What is left is compiled into one Spark column
expression over the statistics, so that scoring is a map over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from operator import add, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import as_bytes, own_name, word_runs

SAMPLE_ROWS = 20_000  # expected labelled rows used for fitting; all of them if there are fewer
TREES, DEPTH, BINS, LEARNING_RATE = 24, 3, 24, 0.3
LASSO = 2e-3

_DIGIT, _UPPER, _LOWER = (bytes(range(*x)) for x in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)))
_SPACE = b" \t\n\r\x0b\x0c"
_MARK = b"#*$%&|<>@^_~=+\\/{}[]"
_END = b".,;:!?"
_LOUD = b"!?"
STATISTICS = [
    "log_words", "word_bytes", "digit_share", "upper_share", "mark_share", "end_share", "loud_share", "other_share",
    "distinct_share", "same_next_share", "top_share", "line_words", "repeated_line_share",
]


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text, all zero for one without words."""
    n, same = 0, 0
    counts: Counter[bytes] = Counter()
    for words in word_runs(text):
        counts.update(words)
        same += sum(map(eq, words, words[1:]))
        n += len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    solid = size - sum(map(text.count, (_SPACE[i : i + 1] for i in range(len(_SPACE)))))
    share = {k: (size - len(text.translate(None, v))) / solid for k, v in
             (("digit", _DIGIT), ("upper", _UPPER), ("mark", _MARK), ("end", _END), ("loud", _LOUD))}
    ascii_letters = size - len(text.translate(None, _LOWER + _UPPER))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        math.log1p(n), solid / n, share["digit"], share["upper"], share["mark"], share["end"], share["loud"],
        1 - ascii_letters / solid, len(counts) / n, same / n, max(counts.values()) / n, n / len(lines) if lines else n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


def statistics_column(text: str) -> Column:
    """A struct of the statistics. Null counts as empty."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:double" for c in STATISTICS) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        values = np.array([statistics(t) for t in as_bytes(texts)], np.float64).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(c) for c in values.T.copy()], STATISTICS)

    return measure.asNondeterministic()(F.col(text).cast("binary"))  # or a filter on a score would measure twice


#: A condition is (statistic, above, threshold): greater than the threshold, or not.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    """Rules with their weights; the score is the logistic function of their sum."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, stats: str) -> Column:
        """The score over the struct column ``stats``."""

        def holds(rule: Rule) -> Column:
            parts = [F.col(f"{stats}.{STATISTICS[i]}") > t if above else F.col(f"{stats}.{STATISTICS[i]}") <= t
                     for i, above, t in rule]
            return reduce(Column.__and__, parts)

        parts = [F.when(holds(r), w).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)]
        return 1 / (1 + F.exp(-reduce(add, parts, F.lit(self.intercept))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + _rule_matrix(self.rules, x) @ np.array(self.weights, np.float64)
        return 1 / (1 + np.exp(-z))


def _rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for i, above, t in rule:
            out[:, k] *= (x[:, i] > t) if above else (x[:, i] <= t)
    return out


def _simplified(path: list[tuple[int, bool, float]]) -> Rule:
    """The tightest condition per statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for i, above, t in path:
        old = best.get((i, above), t)
        best[i, above] = max(old, t) if above else min(old, t)
    return tuple(sorted((i, above, t) for (i, above), t in best.items()))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int):
    """The paths of a tree that fits the gradients, and its value for each row."""
    paths: list[list[tuple[int, bool, float]]] = []
    value = np.zeros(len(grad))

    def split(rows: np.ndarray, path: list, left_depth: int) -> None:
        if path:
            paths.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if left_depth and len(rows) >= 20:
            for i, edges in enumerate(cuts):
                if not len(edges):
                    continue
                gs = np.bincount(bins[rows, i], grad[rows], len(edges) + 1).cumsum()[:-1]
                hs = np.bincount(bins[rows, i], hess[rows], len(edges) + 1).cumsum()[:-1]
                ns = np.bincount(bins[rows, i], minlength=len(edges) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 5) | (len(rows) - ns < 5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), i, k)
        if best[1] < 0:
            value[rows] = g / (h + 1)
            return
        _, i, k = best
        low = bins[rows, i] <= k
        t = float(cuts[i][k])
        split(rows[low], [*path, (i, False, t)], left_depth - 1)
        split(rows[~low], [*path, (i, True, t)], left_depth - 1)

    split(np.arange(len(grad)), [], depth)
    return paths, value


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The distinct rules of boosted trees."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    z = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, value = _grow(bins, cuts, y - p, p * (1 - p), depth)
        rules.update((_simplified(path), None) for path in paths)
        z += LEARNING_RATE * value
    return list(rules)


def lasso_weights(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression with an absolute penalty, by accelerated proximal gradients."""
    mean, spread = r.mean(0), r.std(0)
    spread[spread < 1e-9] = np.inf
    scaled = (r - mean) / spread
    bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w = np.zeros(r.shape[1])
    ahead, ahead_bias, t = w, bias, 1.0
    top = np.ones(r.shape[1])
    for _ in range(20):  # the largest curvature
        top = scaled.T @ (scaled @ top)
        top /= np.linalg.norm(top) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(scaled @ top) ** 2 / len(y) + 1) + 1e-9)
    for _ in range(steps):
        slope = 1 / (1 + np.exp(-(scaled @ ahead + ahead_bias))) - y
        stepped = ahead - rate * (scaled.T @ slope) / len(y)
        nxt = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * penalty, 0)
        nxt_bias = ahead_bias - rate * slope.mean()
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = nxt + (t - 1) / t_next * (nxt - w)
        ahead_bias = nxt_bias + (t - 1) / t_next * (nxt_bias - bias)
        w, bias, t = nxt, nxt_bias, t_next
    weights = w / spread
    return float(bias - weights @ mean), weights


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model from statistics and labels 0 or 1. Without labels of both kinds the score is one smoothed constant."""
    if not len(y) or y.min() == y.max():
        return RuleModel(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    intercept, weights = lasso_weights(_rule_matrix(rules, x), y)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(intercept, [rules[i] for i in used], [float(weights[i]) for i in used])


def is_held_out(doc_id: str) -> Column:
    """Rows never used for fitting: those whose crc32 of the id as text leaves 1 when divided by 3; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> RuleModel:
    """Fits on about ``sample_rows`` labelled documents, chosen by a hash of the id.

    Labels that are null, are neither 0 nor 1, or have a null id are left out; of several labels of one id the largest
    counts, and of several documents with one id the least statistics. The sample alone is broadcast and collected.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~is_held_out(doc_id))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(F.col(label)).cast("double").alias("y"))
    )
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("id", "y", statistics_column("text").alias("stats"))
        .groupBy("id", "y")
        .agg(F.min("stats").alias("stats"))
        .orderBy("id")
        .select("y", "stats.*")
        .toArrow()
    )
    table = np.stack([rows[c].to_numpy() for c in ["y", *STATISTICS]], 1) if rows.num_rows else np.zeros((0, 1 + len(STATISTICS)))
    return fit_rules(table[:, 1:], table[:, 0])


def scored(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the score, from 0 to 1. Null and empty texts have all statistics zero."""
    stats = own_name(docs, "stats")
    out = docs.withColumn(stats, statistics_column(text))
    return out.withColumn(name, model.score(stats)).drop(stats)
