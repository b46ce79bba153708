"""A bag kept from add and delete events.

``events`` has a value, a sequence number and ``delta`` (1 adds one copy, -1 deletes one). Deleting a value that has
no copy is an error and changes nothing. With running sum S of the deltas, the count after an event is therefore
``S - least(0, lowest S so far)``. The sum and the lowest sum of a run of events are all that later events need of
it, which is what lets a hot value be worked on in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.operators.hot_keys import HOT, SLICE, SLICE_ROWS, across, before, join_small, number_rows, running, with_slices, within

FEW = 10_000  # values that are drawn in one task


def _running(sliced: DataFrame, value: str, seq: str, delta: str) -> DataFrame:
    return sliced.withColumn("_run", F.sum(delta).over(running(within([value], seq))))


def _totals(runs: DataFrame, value: str, delta: str) -> DataFrame:
    """Sum and lowest running sum of each slice. ``runs`` is partitioned by slice already: no shuffle."""
    return runs.groupBy(value, SLICE).agg(F.sum(delta).alias("_sum"), F.min("_run").alias("_low"))


def bag_counts(
    events: DataFrame, value: str = "bag_value", seq: str = "seq", delta: str = "delta", limit: int = SLICE_ROWS
) -> DataFrame:
    """(value, n) of the values that have copies left."""
    slices = _totals(_running(with_slices(events.select(value, seq, delta), [value], seq, limit), value, seq, delta), value, delta)
    base = F.coalesce(F.sum("_sum").over(before(across([value]))), F.lit(0))
    whole = (
        slices.withColumn("_low", base + F.col("_low"))
        .groupBy(value)
        .agg(F.sum("_sum").alias("_sum"), F.min("_low").alias("_low"))
    )
    count = (F.col("_sum") - F.least(F.lit(0), F.col("_low"))).cast("bigint")
    return whole.select(value, count.alias("n")).filter(F.col("n") > 0)


def bag_bad_deletes(
    events: DataFrame, value: str = "bag_value", seq: str = "seq", delta: str = "delta", limit: int = SLICE_ROWS
) -> DataFrame:
    """(value, seq) of the deletes that found no copy."""
    sliced = with_slices(events.select(value, seq, delta), [value], seq, limit)
    runs = _running(sliced, value, seq, delta)
    lowest_before = F.min("_run").over(before(within([value], seq)))
    inside = runs.withColumn("_low", lowest_before)

    # Copies at the start of each later slice of a hot value.
    w = across([value])
    after = F.col("_all") - F.least(F.lit(0), F.col("_all_low"))
    starts = (
        _totals(_running(sliced.filter(HOT), value, seq, delta), value, delta)
        .withColumn("_all", F.sum("_sum").over(running(w)))
        .withColumn("_all_low", F.min(F.col("_all") - F.col("_sum") + F.col("_low")).over(running(w)))
        .withColumn("_start", F.lag(after).over(w))
        .select(value, SLICE, "_start")
    )
    start = F.coalesce(F.col("_start"), F.lit(0))
    sum_before = F.col("_run") - F.col(delta)
    count_before = sum_before - F.least(-start, F.col("_low"))
    return (
        join_small(inside, starts, [value, SLICE], "left")
        .filter((F.col(delta) == -1) & (count_before == 0))
        .select(value, seq)
    )


def bag_sample(
    counts: DataFrame, k: int = 1, seed: int | str = 0, value: str = "bag_value", repeatable: bool = True,
    few: int = FEW, limit: int = SLICE_ROWS,
) -> DataFrame:
    """``k`` different values, each drawn with a chance that grows with its copies; ``k=1`` picks one element of the
    bag evenly. Drawing from an empty bag is an error.

    Each value gets the rank ``-ln(u) / n`` and the k smallest win (Efraimidis and Spirakis, 2006). Up to ``few``, every task
    keeps its own k best and only those travel, to one task. For more, values are numbered by rank in slices of ``limit``, and the
    first k stay where they are. Both draw the same values. ``repeatable`` takes u from a hash of seed and value.
    """
    if repeatable:
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(value).cast("string"))), 1, 8)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    else:
        u = 1.0 - F.rand(int(seed))
    ranked = counts.withColumn("_rank", -F.log(u) / F.col("n"))
    if k > few:
        numbered = number_rows(ranked.withColumn("_all", F.lit(0)), ["_all"], "_rank", "_number", limit, (value,))
        drawn = numbered.filter(F.col("_number") < k).select(value)
        # A row that fails if there is nothing to draw from, and is left out otherwise.
        size = counts.agg(F.count("*").alias("_size"))
        checked = F.when(F.col("_size") > 0, F.lit(False)).otherwise(F.raise_error(F.lit("the bag is empty")).cast("boolean"))
        return drawn.unionByName(size.filter(checked).select(F.lit(None).cast(drawn.schema[value].dataType).alias(value)))
    drawn = ranked.orderBy("_rank", value).limit(k)
    # One row even if nothing was drawn, so that the bag is computed once.
    values = drawn.agg(F.collect_list(value).alias("_values"))
    some = F.when(F.size("_values") > 0, F.col("_values")).otherwise(
        F.raise_error(F.lit("the bag is empty")).cast(values.schema["_values"].dataType)
    )
    return values.select(F.explode(some).alias(value))
