"""Which group reads which partitions of which topic.

One long table (topic, grp, part_id) serves both directions; the nested forms are views of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.operators.hot_keys import SLICE_ROWS, previous_value
from loglens.operators.latest import latest
from loglens.operators.nested import nest

KEYS = ["grp", "topic", "part_id"]
TOPIC_TO_GROUP = 1
GROUP_TO_TOPIC = 2


def ever_seen(commits: DataFrame) -> DataFrame:
    """Every (topic, grp, part_id) that was ever committed."""
    return commits.filter(F.col("committed").isNotNull()).select("topic", "grp", "part_id").distinct()


def live(commits: DataFrame) -> DataFrame:
    """Those not expired since: emptied groups and topics vanish by themselves."""
    return latest(commits, KEYS, "committed", "log_pos").select("topic", "grp", "part_id")


def partitions_by(index: DataFrame, outer: str, inner: str, pieces: int = 1) -> DataFrame:
    """(outer, inner, piece, parts) with sorted partitions; ``("topic", "grp")`` or ``("grp", "topic")``."""
    return nest(index, [outer, inner], ["part_id"], F.col("part_id"), "parts", pieces)


def dump(index: DataFrame) -> DataFrame:
    """Both directions as tagged entries: ``index_kind, entry_key, entry_name, part_id``."""

    def entries(outer: str, inner: str, kind: int) -> DataFrame:
        return index.select(
            F.lit(kind).alias("index_kind"), F.col(outer).alias("entry_key"), F.col(inner).alias("entry_name"), "part_id"
        )

    return entries("topic", "grp", TOPIC_TO_GROUP).unionByName(entries("grp", "topic", GROUP_TO_TOPIC))


def orphan_tombstones(commits: DataFrame, earlier: DataFrame | None = None, limit: int = SLICE_ROWS) -> DataFrame:
    """Deletes of keys that hold no live entry: the record before is a tombstone too, or there is none.

    ``earlier`` may give the newest record of each key before these (grp, topic, part_id, log_pos, committed).
    """
    columns = [*KEYS, "log_pos", F.col("committed").isNotNull().alias("_live")]
    rows = commits.select(*columns, F.lit(True).alias("_new"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select(*columns, F.lit(False).alias("_new")))
    seen = previous_value(rows, KEYS, "log_pos", "_live", "_was_live", limit)
    orphan = F.col("_new") & ~F.col("_live") & ~F.coalesce(F.col("_was_live"), F.lit(False))
    return seen.filter(orphan).select("log_pos", *KEYS)


def groups(commits: DataFrame) -> DataFrame:
    """Groups that appear in the commit log."""
    return commits.select("grp").distinct()
