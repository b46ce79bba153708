"""Tables that a stream keeps up to date.

Each micro-batch writes to a folder of its own, so a batch that is run again after a failure replaces what it wrote
before. An empty file, made last, notes that the batch is whole; readers go by these notes and never see half a batch.
A table of all rows is only appended to. A table of merged rows is written anew, as a base from which readers start, once the
batches since the last base are as large as that base: so all bases together take at most twice the bytes of all batches.
Nothing is removed unless the table is given an age: then what later batches have replaced goes once it is older. The age
should exceed the longest time that anyone reads one state of the table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA, BASE = "delta", "base"
GONE = "gone"  # a column that marks keys without rows


class Note(NamedTuple):
    batch: int
    base: int
    since: int = 0  # bytes of the batches after the base
    size: int = 0  # bytes of the base


class Notes:
    """Names ``<batch>.<base>.<bytes since>.<bytes of the base>`` in a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.make_path = jvm.org.apache.hadoop.fs.Path
        self.folder = self.make_path(f"{path}/notes")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def add(self, note: Note) -> None:
        self.files.create(self.make_path(self.folder, ".".join(map(str, note))), True).close()

    def bytes(self, path: str) -> int:
        return self.files.getContentSummary(self.make_path(path)).getLength()

    def expire(self, keep_seconds: float) -> None:
        """Removes the notes older than that, but for the last."""
        oldest = (time.time() - keep_seconds) * 1000
        last = self.last()
        for s in self.files.listStatus(self.folder):
            if s.getModificationTime() <= oldest and self._read(s) != last:
                self.files.delete(s.getPath(), False)

    def numbered(self, path: str, prefix: str = "") -> dict[int, str]:
        """Folders of a folder by their number."""
        where = self.make_path(path)
        if not self.files.exists(where):
            return {}
        found = [s.getPath() for s in self.files.listStatus(where) if s.isDirectory()]
        numbers = {p.getName().removeprefix(prefix): p.toString() for p in found}
        return {int(n): p for n, p in numbers.items() if n.isdigit()}

    def _read(self, status) -> Note:
        return Note(*map(int, status.getPath().getName().split(".")))

    def all(self) -> list[Note]:
        if not self.files.exists(self.folder):
            return []
        return sorted(map(self._read, self.files.listStatus(self.folder)))

    def last(self, upto: int | None = None) -> Note | None:
        if upto is not None:
            # Mostly this very batch is noted, and the others need not be listed.
            near = self.files.globStatus(self.make_path(self.folder, f"{upto}.*"))
            if near:
                return max(map(self._read, near))
        found = [n for n in self.all() if upto is None or n.batch <= upto]
        return found[-1] if found else None

    def remove(self, path: str) -> None:
        self.files.delete(self.make_path(path), True)


class ChangeTable:
    """Holds the changes of each batch; a batch without changes need not be written.

    ``merge`` reduces the rows of several batches, told apart by ``batch_id``, to the present table. It must be free
    to run over its own results, as a latest-per-key or a maximum is. Without it the table has the rows of all batches.
    A base is written after ``compact_every`` batches at the earliest, and only if they outgrow the last base.

    With ``slot_by`` the rows of a value of that column are in the folder of one of ``slots`` slots, in order and with a bloom
    filter, so that a lookup of one value reads one file a batch, or only its filter. ``slots`` must stay the same.
    """

    def __init__(
        self,
        path: str,
        merge: Callable[[DataFrame], DataFrame] | None = None,
        compact_every: int = 50,
        keep_seconds: float | None = None,
        slot_by: str | None = None,
        slots: int = 64,
    ):
        self.path, self.merge, self.compact_every, self.keep_seconds = path, merge, compact_every, keep_seconds
        self.slot_by, self.slots = slot_by, slots

    def write(self, changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        notes = Notes(spark, self.path)
        # Notes of earlier batches only: this batch may have been written before.
        before = notes.last(batch_id - 1) or Note(-1, -1)
        self._put(changes, DELTA, batch_id)
        since = before.since + notes.bytes(self._folder(DELTA, batch_id)) if self.merge else 0
        note = Note(batch_id, before.base, since, before.size)
        if self.merge and batch_id - max(before.base, 0) >= self.compact_every and since >= before.size:
            self._put(self.merge(self._rows(spark, before.base, batch_id)), BASE, batch_id)
            note = Note(batch_id, batch_id, 0, notes.bytes(self._folder(BASE, batch_id)))
        notes.add(note)
        if self.keep_seconds is not None:
            notes.expire(self.keep_seconds)
            needed = min(n.base for n in notes.all())
            for b, folder in notes.numbered(f"{self.path}/rows/kind={DELTA}", "batch_id=").items():
                if b <= needed:
                    notes.remove(folder)
            for b, folder in notes.numbered(f"{self.path}/rows/kind={BASE}", "batch_id=").items():
                if b < needed:
                    notes.remove(folder)

    def has(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether the batch is noted."""
        last = Notes(spark, self.path).last(batch_id)
        return last is not None and last.batch == batch_id

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The table after batch ``upto``, if still kept, or after the last whole batch."""
        last = Notes(spark, self.path).last(upto)
        if last is None:
            raise ValueError(f"nothing has been written to {self.path} yet")
        rows = self._rows(spark, last.base, last.batch)
        return self.merge(rows) if self.merge else rows

    def lookup(self, spark: SparkSession, wanted) -> DataFrame:
        """The rows with one value of the column ``slot_by`` in the table after the last whole batch."""
        last = Notes(spark, self.path).last()
        if last is None or self.slot_by is None:
            raise ValueError(f"{self.path} has no slots or nothing has been written to it yet")
        rows = self._rows(spark, last.base, last.batch, keep_slot=True)
        kind = rows.schema[self.slot_by].dataType
        here = (F.col("slot") == self._slot(F.lit(wanted).cast(kind))) & (F.col(self.slot_by) == F.lit(wanted).cast(kind))
        rows = rows.filter(here).drop("slot")
        return self.merge(rows) if self.merge else rows

    def _slot(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.slots)).cast("int")

    def changes(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What one batch wrote."""
        rows = spark.read.parquet(self._folder(DELTA, batch_id))
        return rows.drop("slot") if self.slot_by else rows

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/rows/kind={kind}/batch_id={batch_id}"

    def _put(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        kept = [c for c in rows.columns if c not in ("kind", "batch_id")]
        rows = rows.select(*kept)
        if self.slot_by:
            by = self.slot_by
            rows = rows.withColumn("slot", self._slot(F.col(by))).repartition("slot").sortWithinPartitions("slot", by)
            writer = rows.write.partitionBy("slot").option(f"parquet.bloom.filter.enabled#{by}", "true")
        else:
            writer = rows.write
        writer.mode("overwrite").parquet(self._folder(kind, batch_id))

    def _rows(self, spark: SparkSession, base: int, last: int, keep_slot: bool = False) -> DataFrame:
        reader = spark.read.option("basePath", f"{self.path}/rows")
        if base < 0:
            rows = reader.parquet(f"{self.path}/rows/kind={DELTA}").filter(F.col("batch_id") <= last)
        else:
            # Named folders, so that the files before the base are not even listed.
            found = Notes(spark, self.path).numbered(f"{self.path}/rows/kind={DELTA}", "batch_id=")
            deltas = [self._folder(DELTA, b) for b in sorted(found) if base < b <= last]
            rows = reader.parquet(self._folder(BASE, base), *deltas)
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("bigint")).drop("kind")
        return rows.drop("slot") if self.slot_by and not keep_slot else rows

