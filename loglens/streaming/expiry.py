"""Last values that are given up after a time without records.

State is kept for ever unless a job is given a time to live, as deletes arrive as records. With it, each record of a key
starts the key's time anew; when it has run out, the key leaves the state and its row leaves the job's table. The engine
keeps such state in the RocksDB provider only, which the session has to name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loglens.streaming.tables import GONE

# The engine first reads the processor in a process that does not have the driver's path of modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD = 1 << 18  # keys of a task that are reduced before they are sent on


def newest_of_task(keys: list[str], order: str):
    """Reduces the records of a task to the newest of each key, so that a hot key sends one record a task."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        newest: pd.DataFrame | None = None
        for rows in batches:
            rows = rows if newest is None else pd.concat([newest, rows])
            newest = rows.sort_values(order, kind="stable").drop_duplicates(keys, keep="last")
            if len(newest) > HELD:
                yield newest
                newest = None
        if newest is not None:
            yield newest

    return reduce


class ExpiringLatest(StatefulProcessor):
    """The newest record of a key by ``order``; timers give up keys without records for ``ttl_ms``."""

    def __init__(self, keys: list[str], value: str, order: str, ttl_ms: int, state: str):
        self.keys, self.value, self.order, self.ttl_ms, self.schema = keys, value, order, ttl_ms, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _row(self, key: tuple, order, value, gone: bool) -> pd.DataFrame:
        named = dict(zip(self.keys, key, strict=True))
        return pd.DataFrame({**{k: [v] for k, v in named.items()}, self.value: [value], self.order: [order], GONE: [gone]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for frame in rows:
            newest = frame.loc[frame[self.order].idxmax()]
            if last is None or newest[self.order] > last[0]:
                value = newest[self.value]
                last = int(newest[self.order]), None if pd.isna(value) else value
        self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield self._row(key, *last, last[1] is None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        order, _ = self.last.get()
        self.last.clear()
        yield self._row(key, order, None, True)

    def close(self) -> None:
        pass


def expiring_latest(stream: DataFrame, keys: list[str], value: str, order: str, ttl_seconds: float) -> DataFrame:
    """Changed rows of keys (keys, value, order), marked as gone for a deleted key and one whose time has run out. ``order`` is a
    whole number."""
    kinds = dict(stream.dtypes)
    rows = stream.select(*keys, value, F.col(order).cast("bigint").alias(order))
    own = ", ".join(f"{c} {kinds[c]}" for c in (*keys, value)) + f", {order} bigint"
    reduced = rows.mapInPandas(newest_of_task(keys, order), own)
    processor = ExpiringLatest(keys, value, order, int(ttl_seconds * 1000), f"ord bigint, val {kinds[value]}")
    return reduced.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{own}, {GONE} boolean", outputMode="Update", timeMode="ProcessingTime"
    )
