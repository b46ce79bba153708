"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text gives a vector of transformed statistics. For every cell of language and source the mean and covariance of the
least spread share of its rows are found by concentration steps: rows are ranked by their Mahalanobis distance from the
current estimate, and the nearest share gives the next one. A step is one aggregate. Distances fall into narrow bins whose
moments are summed in every task, and the bins up to the share are added up per cell, so a cell with a third of all rows
costs a task no more than its bins. Rows too far from the reweighted estimate are outliers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.shared import as_bytes, stored, word_runs

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_TAILS = bytes(range(0x80, 0xC0))  # the bytes of a character after its first

#: The transformed statistics, and the least standard deviation that is believed of each.
VECTOR = ["log_words", "log_word_chars", "symbol_root", "dup_line_root", "repeat_share"]
#: The root of a count deviates by a half whatever its mean, so the root of a share of n characters by 0.5 / sqrt(n); the
#: shortest texts that are judged have ``MIN_WORDS`` words of about five characters.
LEAST_DEVIATION = (0.3, 0.1, 0.5 / math.sqrt(5 * MIN_WORDS), 0.05, 0.05)
MIN_ROWS = 50  # cells with fewer rows are pooled by language, then altogether, then judged by all rows
EVERY = "every"
SHARE = 0.75
STEPS = 4
CUTOFF = 1e-6  # chance of a larger distance under normality
_BINS_PER_DOUBLING = 32
_D = len(VECTOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]


def repeated_words(text: bytes) -> tuple[int, int]:
    """(words, words that lie in a window of three words found twice or more in the text)."""
    numbers: dict[bytes, int] = {}
    pieces = []
    for words in word_runs(text):
        pieces.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    if not pieces:
        return 0, 0
    ids = np.concatenate(pieces)
    if len(ids) < 4:
        return len(ids), 0
    width = len(numbers)
    _, pairs = np.unique(ids[:-1] * width + ids[1:], return_inverse=True) if width > 1 << 20 else (0, ids[:-1] * width + ids[1:])
    _, which, counts = np.unique(pairs[:-1] * width + ids[2:], return_inverse=True, return_counts=True)
    often = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    return len(ids), int(covered.sum())


def base_counts(text: bytes) -> list[int]:
    """The counts of a whole text, in the order of ``COUNTS``."""
    n_words, n_repeat = repeated_words(text)
    lines = Counter(line for line in text.split(b"\n") if line.translate(None, _SPACE))
    return [
        n_words,
        len(text.translate(None, _SPACE + _TAILS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        lines.total() - len(lines),
        n_repeat,
    ]


def counts_column(text: str) -> Column:
    """A struct of the counts. Null counts as empty."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        values = np.array([base_counts(t) for t in as_bytes(texts)], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(c) for c in values.T.copy()], COUNTS)

    return count.asNondeterministic()(F.col(text).cast("binary"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,  # comes in whole passages, so small shares are common and not stretched
    ]


def chi_square_below(x: float, d: int) -> float:
    """The chi-square distribution function, from the series of the incomplete gamma function."""
    a, half = d / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= half / (a + k)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, d) < p else (low, mid)
    return (low + high) / 2


def _inflation(share: float) -> float:
    """What makes the covariance of the nearest share right for normal data."""
    return share / chi_square_below(chi_square_quantile(share, _D), _D + 2)


def _estimates(cells: DataFrame, inflation: float) -> DataFrame:
    """(cell, mean, precision) from (cell, n, sums, products); the deviations are at least ``LEAST_DEVIATION``."""

    def invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.square(LEAST_DEVIATION)
        for part in parts:
            out = []
            for cell, n, sums, products in part.itertuples(index=False):
                mean = np.asarray(sums, float) / n
                cov = np.zeros((_D, _D))
                for (i, j), v in zip(_PAIRS, products, strict=True):
                    cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
                cov = cov * inflation + np.diag(np.maximum(least - np.diag(cov) * inflation, 0))
                cov += 1e-6 * np.diag(np.diag(cov))
                inverse = np.linalg.inv(cov)
                out.append((cell, mean.tolist(), [float(inverse[i, j]) for i, j in _PAIRS]))
            yield pd.DataFrame(out, columns=["cell", "mean", "precision"])

    return cells.mapInPandas(invert, "cell string, mean array<double>, precision array<double>")


def _distance() -> Column:
    """The squared Mahalanobis distance of the column ``v`` from ``mean`` under ``precision``."""
    off = [F.col("v")[i] - F.col("mean")[i] for i in range(_D)]
    return reduce(add, [F.col("precision")[k] * off[i] * off[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)])


def _moments() -> list[Column]:
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(_D)]
    return [F.count("*").alias("n"), *sums, *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}{j}") for i, j in _PAIRS]]


def _packed(moments: DataFrame) -> DataFrame:
    return moments.select(
        "cell", "n", F.array(*[f"s{i}" for i in range(_D)]).alias("sums"), F.array(*[f"p{i}{j}" for i, j in _PAIRS]).alias("products")
    )


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges, as a first estimate without correlations."""
    quartiles = [F.percentile_approx(F.col("v")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(_D)]
    found = rows.groupBy("cell").agg(*quartiles)
    deviation = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(LEAST_DEVIATION[i])) for i in range(_D)]
    return found.select(
        "cell",
        F.array(*[F.col(f"q{i}")[1] for i in range(_D)]).alias("mean"),
        F.array(*[1 / (deviation[i] * deviation[i]) if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("precision"),
    )


def _concentrated(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """The estimate from the nearest ``share`` of each cell's rows."""
    far = F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-20))) * _BINS_PER_DOUBLING).cast("int")
    bins = rows.join(estimate, "cell").withColumn("bin", far).groupBy("cell", "bin").agg(*_moments())
    nearer = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cell")
    bins = bins.withColumns({"before": F.coalesce(F.sum("n").over(nearer), F.lit(0)), "all": F.sum("n").over(whole)})
    bins = bins.filter(F.col("before") < F.col("all") * share)
    names = ["n", *[f"s{i}" for i in range(_D)], *[f"p{i}{j}" for i, j in _PAIRS]]
    return _estimates(_packed(bins.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names])), _inflation(share))


def _cells(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, cell): the cell of each language and source. If all small ones together are too few, theirs is the cell
    of all rows."""
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang", F.col("n") >= min_rows)
    groups = groups.withColumn("pool", F.sum("n").over(by_lang))
    scattered = F.when((F.col("n") < min_rows) & (F.col("pool") < min_rows), F.col("n"))
    groups = groups.withColumn("rest", F.sum(scattered).over(Window.partitionBy()))  # a row per language and source
    cell = (
        F.when(F.col("n") >= min_rows, F.to_json(F.struct(F.lit(1), "lang", "source")))
        .when(F.col("pool") >= min_rows, F.to_json(F.struct(F.lit(2), "lang")))
        .when(F.col("rest") >= min_rows, F.lit("all"))
        .otherwise(F.lit(EVERY))
    )
    return groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), cell.alias("cell"))


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_rows: int = MIN_ROWS,
    share: float = SHARE,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """(doc_id, the counts, base_failed, distance, kept) per row.

    ``base_failed`` texts have fewer than 50 words or more than half of their words in repeated windows; they are not kept
    and take no part in estimates. Others are kept unless their squared distance exceeds the chi-square quantile of
    ``cutoff``. Null and empty texts have no words. A null language or source is a group of its own; where even all
    small groups together have fewer than ``min_rows`` rows, theirs are judged by the estimate of all rows that pass.
    Repeated rows all count. Empty tables give no rows; other columns are not read.
    """
    counted = docs.select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        counts_column(text).alias("counts"),
    ).select("id", "lang", "source", "counts.*")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    light = stored(counted.withColumns({"base_failed": failed, "v": F.array(*_vector())}), "counts")

    cells = stored(_cells(light.filter(~F.col("base_failed")), min_rows), "cells")
    same = light["lang"].eqNullSafe(cells["of_lang"]) & light["source"].eqNullSafe(cells["of_source"])
    placed = light.join(cells, same, "left")
    rows = placed.filter(~F.col("base_failed")).select("cell", "v")
    if not cells.filter(F.col("cell") == EVERY).isEmpty():
        passed = light.filter(~F.col("base_failed")).select(F.lit(EVERY).alias("cell"), "v")
        rows = rows.filter(F.col("cell") != EVERY).unionByName(passed)

    estimate = stored(_start(rows), "estimate")
    for _ in range(STEPS):
        estimate = stored(_concentrated(rows, estimate, share), "estimate")
    near = rows.join(estimate, "cell").filter(_distance() <= chi_square_quantile(0.975, _D))
    estimate = stored(_estimates(_packed(near.groupBy("cell").agg(*_moments())), 1.0), "estimate")

    judged = placed.join(estimate, "cell", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    near_enough = F.coalesce(F.col("distance") <= chi_square_quantile(1 - cutoff, _D), F.lit(True))
    return judged.select(
        F.col("id").alias(doc_id), *COUNTS, "base_failed", "distance", (~F.col("base_failed") & near_enough).alias("kept")
    )
