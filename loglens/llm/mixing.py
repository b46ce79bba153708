"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a random key from a hash of its id. A source's key range is cut into ranges of about ``RANGE_ROWS``
documents. Rows are shuffled by source and range and sorted by key within them; prefix sums over the few totals of the
ranges carry the running sum from range to range, so no task ever holds a whole source. A source's budget takes so many
whole epochs and then the documents in key order, the last one in part, until it is spent exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.shared import WORD, own_name, stored

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
RANGE_ROWS = 4096
SEED = "mix"
_KEY_BITS = 52


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``sizes`` (one row per source: source, source_size, …) with ``target``.

    Sources by code point, null last, get the weights in turn and share ``total_share`` of all words. A target
    stops at ``max_epochs`` times its source's size, and what is over goes to the others by weight. The sources are ranked
    by a window over the table of sources, which has one small row for each.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("weight", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumns(
        {"cap": (F.col("source_size") * max_epochs).cast("double"), "total": F.sum("source_size").over(everything) * total_share}
    )
    # Sources reach their caps in the order of cap / weight; the level is the highest that is not above the cap / weight at its place.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    sooner = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(sooner), F.lit(0.0))) / F.sum("weight").over(later)
    w = w.withColumn("level", level)
    w = w.withColumn("reached", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("reached") * F.col("weight"), F.col("cap")))
    return w.withColumn("target", target).drop("weight", "cap", "total", "level", "reached")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) per row. ``size`` is the number of words, ``taken`` how many of
    them the mix takes, epochs counted: a multiple of the size, but for the one document of a source that is cut.

    Null and empty texts have size 0 and nothing is taken of them. Null is a source of its own. Rows with equal ids have
    equal keys and are ordered by size; a null id is a key like any other. Empty tables give no rows; other columns are
    not read. Runs over the same rows agree.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(SEED))), 1, 13), 16, 10)
    light = stored(
        docs.select(
            F.col(doc_id).alias("id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            key.cast("bigint").alias("key"),
        ),
        "sizes",
    )
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    budget = F.floor(F.col("target") + 0.5)
    targets = source_targets(sizes, weights, total_share, max_epochs).select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.ceil(F.col("rows") / range_rows).alias("ranges"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("rest"),
    )
    place = F.floor(F.col("key") / F.lit(float(1 << _KEY_BITS)) * F.col("ranges")).cast("bigint")
    placed = light.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", place)
    in_range = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("source").alias("of"),
        F.col("range").alias("at"),
        F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("carried"),
    )
    summed = placed.drop("of").withColumn("inside", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    summed = summed.join(carried, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    cut = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("carried") - F.col("inside")))
    return summed.select(
        F.col("id").alias(doc_id),
        "size",
        F.col("source").alias(own_name(docs.select(doc_id), "source")),
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + cut).cast("bigint").alias("taken"),
    )
