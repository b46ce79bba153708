"""Last value per key, with deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FIXED_WIDTH = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def newest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The record with the highest ``order`` per key, tombstones included: ``value`` is null where it was deleted.

    An aggregate and no window: every task first reduces its own rows to one per key, so a hot key costs nothing
    extra. With fixed-width values such as offsets it is a hash aggregate.
    """
    newest_value = [F.max_by(value, order).alias(value), F.max(order).alias(order)]
    if rows.isStreaming or dict(rows.dtypes)[value] in FIXED_WIDTH:
        return rows.groupBy(*keys).agg(*newest_value)
    # Other values are aggregated by sorting. A hash as the first key lets nearly all comparisons end at its eight
    # bytes, where a leading column with few values, such as a topic, would have them read on.
    by = [F.xxhash64(*keys).alias("_hash"), *keys]
    return rows.groupBy(*by).agg(*newest_value).drop("_hash")


def latest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Live keys only: a key whose newest record has a null value is gone."""
    return newest(rows, keys, value, order).filter(F.col(value).isNotNull()).select(*keys, value)


def lookup(table: DataFrame, key: str, wanted: str) -> DataFrame:
    """Point lookup; on a parquet table the filter reaches the scan."""
    return table.filter(F.col(key) == wanted)
