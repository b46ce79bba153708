"""Ordered work on keys that may hold a large share of all rows.

A window over one key runs in one task. The heaviest keys with more than ``limit`` rows, ``MOST`` of them, are cut into slices by
the rank of the sequence number; the window runs within (key, slice) and small per-slice totals carry the result
across slices. All other keys keep the single slice 0, so their rows are shuffled once and need nothing carried. None of them
has more than a ``MOST``-th of all rows. Null is a key like any other.

A count finds the heavy keys; only their rows are ranked for the bounds of slices. What goes to all tasks is bounded by ``MOST``
keys of ``GRID`` bounds, whatever the size of the table. Without heavy keys the count is all that is done besides the window, as the
plan adapts to empty lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 20
SLICE = "_slice"
HOT = "_hot"
MOST = 1024  # keys that are cut
GRID = 1024  # slices of a key at the most
_STEP = 32


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str, hint: str | None = None) -> DataFrame:
    """Joins on keys that may be null; the columns of ``df`` come first."""
    own = [f"_key{i}" for i in range(len(keys))]
    other = other.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(other[o]) for k, o in zip(keys, own, strict=True)))
    return df.join(other.hint(hint) if hint else other, same, how).drop(*own)


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The same with a table of few rows, without moving those of the large one."""
    return join_null_safe(df, small, keys, how, "broadcast")


def heavy_keys(df: DataFrame, keys: list[str], limit: int = SLICE_ROWS) -> DataFrame:
    """The ``MOST`` keys with most rows among those with more than ``limit``, and their number of rows ``_n``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    return counts.orderBy(F.desc("_n"), *keys).limit(MOST)


def join_skewed(df: DataFrame, other: DataFrame, keys: list[str], limit: int | None = SLICE_ROWS) -> DataFrame:
    """Left join with a table that has one row per key at the most. Its rows of heavy keys are sent to all tasks, so that the
    rows of such a key stay spread; the others are joined by the optimizer's choice. Null keys are equal to each other."""
    if limit is None:
        return join_null_safe(df, other, keys, "left")
    heavy = heavy_keys(df, keys, limit).drop("_n")
    marked = join_small(df, heavy.withColumn("_heavy", F.lit(True)), keys, "left")
    few = join_small(other, heavy, keys, "left_semi")
    spread = join_small(marked.filter("_heavy"), few, keys, "left").drop("_heavy")
    met = join_null_safe(marked.filter("_heavy is null").drop("_heavy"), other, keys, "left")
    return spread.unionByName(met.select(*spread.columns))


def hot_keys(df: DataFrame, keys: list[str], seq: str, limit: int = SLICE_ROWS) -> DataFrame:
    """Heavy keys and the sorted bounds between their slices: sequence numbers of evenly spaced rank, so that slices are
    alike in rows however the numbers are spread."""
    ranks = [i / GRID for i in range(1, GRID)]
    theirs = join_small(df.select(*keys, seq), heavy_keys(df, keys, limit).drop("_n"), keys, "left_semi")
    found = theirs.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(seq, ranks, 10 * GRID).alias("_ranked"))
    pieces = F.least(F.lit(GRID), F.ceil(F.col("_n") / limit)).cast("int")
    at = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.element_at("_ranked", (i * GRID / pieces).cast("int")))
    bounds = F.array_sort(F.array_distinct(F.when(pieces > 1, at)))
    every = F.transform(F.sequence(F.lit(0), F.floor(F.size("_bounds") / _STEP).cast("int")), lambda i: i * _STEP)
    coarse = F.transform(F.filter(every, lambda i: i > 0), lambda i: F.element_at("_bounds", i))
    return found.select(*keys, bounds.alias("_bounds")).select("*", coarse.alias("_coarse"))


def with_slices(df: DataFrame, keys: list[str], seq: str, limit: int | None = SLICE_ROWS) -> DataFrame:
    """Adds ``_hot`` and ``_slice``, which rises with ``seq`` within a hot key: the number of bounds below it.

    Slices of a hot key hold about ``limit`` rows each, unless its rows exceed ``GRID`` times that or one sequence
    number repeats. Without a limit no key is cut.
    """
    if limit is None:
        return df.withColumn(HOT, F.lit(False)).withColumn(SLICE, F.lit(0).cast("bigint"))
    marked = join_small(df, hot_keys(df, keys, seq, limit), keys, "left")
    hot = F.col("_bounds").isNotNull()
    skipped = F.size(F.filter("_coarse", lambda b: b < F.col(seq))) * _STEP
    piece = skipped + F.size(F.filter(F.slice("_bounds", skipped + 1, _STEP), lambda b: b < F.col(seq)))
    return marked.select(
        *[F.col(c) for c in df.columns],
        hot.alias(HOT),
        F.when(hot, piece).otherwise(F.lit(0)).cast("bigint").alias(SLICE),
    )


def within(keys: list[str], *order: str):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def across(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, keys: list[str], seq: str, name: str, limit: int = SLICE_ROWS, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Dense row numbers from 0 per key, in the order of ``seq`` and, where that repeats, of ``ties``."""
    sliced = with_slices(df, keys, seq, limit)
    ranked = sliced.withColumn("_rank", F.row_number().over(within(keys, seq, *ties)).cast("bigint"))
    base = (
        sliced.filter(HOT)
        .groupBy(*keys, SLICE)
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(before(across(keys))))
        .drop("_n")
    )
    return join_small(ranked, base, [*keys, SLICE], "left").select(
        *[F.col(c) for c in df.columns],
        (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_rank") - 1).alias(name),
    )


def previous_value(
    df: DataFrame, keys: list[str], seq: str, value: str, name: str, limit: int | None = SLICE_ROWS
) -> DataFrame:
    """``value`` of the record before, per key in ``seq`` order; null for the first record. ``value`` is never null."""
    sliced = with_slices(df, keys, seq, limit)
    inside = sliced.withColumn("_prev", F.lag(value).over(within(keys, seq)))
    tails = (
        sliced.filter(HOT)
        .groupBy(*keys, SLICE)
        .agg(F.max_by(value, seq).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(across(keys)))
        .drop("_tail")
    )
    return join_small(inside, tails, [*keys, SLICE], "left").select(
        *[F.col(c) for c in df.columns], F.coalesce("_prev", "_carry").alias(name)
    )
