"""All records of a commit log in one pass, each with a tag that says whether it is usable.

The log is read and decoded once. Nothing is stored, and no job runs before the result is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loglens.operators.decode import ORPHAN, _commit_fields, is_group
from loglens.operators.group_metadata import with_group_reason
from loglens.operators.index import KEYS

OFFSET_COMMIT = "offset_commit"
GROUP_METADATA = "group_metadata"
BLOCK = 1 << 20  # log positions


def tag(log: DataFrame) -> DataFrame:
    """One row per record: ``log_pos, kind``, the fields of an offset commit, and ``reason``, which is null for good rows.
    That a tombstone is an orphan is not seen from the record alone."""
    rows = with_group_reason(log.select("log_pos", "key", "value")).withColumn(
        "kind", F.when(is_group(F.col("key")), GROUP_METADATA).otherwise(OFFSET_COMMIT)
    )
    fields = _commit_fields(rows, "kind", "group_reason")
    reason = F.when(F.col("kind") == GROUP_METADATA, F.col("group_reason")).otherwise(F.col("reason"))
    return fields.withColumn("reason", reason).drop("group_reason")


def counted(tagged: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds ``n`` and ``n_rejects`` once any action has run over them: no pass of
    its own."""
    seen = Observation(name)
    return tagged.observe(seen, F.count("*").alias("n"), F.count_if(F.col("reason").isNotNull()).alias("n_rejects")), seen


def rejected(tagged: DataFrame, block: int = BLOCK) -> DataFrame:
    """(log_pos, reason) of the records that are not usable, and of the tombstones whose key holds no live entry.

    Good commits are judged in blocks of ``block`` log positions a key, of which none has more records, however many the
    key has. Where a block of a key begins is judged from where the one before ends: of each block two records go on,
    besides those that are found already. These are dealt out by their positions, so no key gathers them.
    """
    is_commit = F.col("reason").isNull() & (F.col("kind") == OFFSET_COMMIT)
    position, live, commit = F.col("log_pos"), F.col("live"), F.col("commit")
    rows = tagged.filter(is_commit | F.col("reason").isNotNull()).select(
        "log_pos", "reason", is_commit.alias("commit"), F.col("committed").isNotNull().alias("live"),
        # A reject has no key, and a block of its own.
        *[F.when(is_commit, F.col(c)).alias(c) for c in KEYS],
        F.when(is_commit, F.floor(position / block)).otherwise(position).alias("block"),
    )
    inside = Window.partitionBy("commit", *KEYS, "block").orderBy("log_pos")
    rows = rows.withColumn("before", F.lag("live").over(inside)).withColumn("after", F.lead("live").over(inside))
    inner_orphan = commit & ~live & F.col("before").isNotNull() & ~F.col("before")
    rows = rows.withColumn("reason", F.when(inner_orphan, ORPHAN).otherwise(F.col("reason")))
    end = commit & (F.col("before").isNull() | F.col("after").isNull())
    rows = rows.filter(F.col("reason").isNotNull() | end)
    # The ends of a key's blocks follow each other; what else is left is found already, and kept apart by its position.
    across = Window.partitionBy(*KEYS, "apart").orderBy("log_pos")
    rows = rows.withColumn("apart", F.when(~end, position)).withColumn("carried", F.lag("live").over(across))
    first_orphan = commit & ~live & F.col("before").isNull() & ~F.coalesce(F.col("carried"), F.lit(False))
    reason = F.when(first_orphan, ORPHAN).otherwise(F.col("reason"))
    return rows.select("log_pos", reason.alias("reason")).filter(F.col("reason").isNotNull())
