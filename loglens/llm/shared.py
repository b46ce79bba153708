"""What several operators use: words of a text in bounded pieces, and tables written to the shared work folder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.session import work_path

WORD = r"[^\x20\x09-\x0D]+"  # as bytes.split() splits, seen as a regular expression
PIECE = 1 << 22  # bytes of a text that are split into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the cluster's shared folder and reads it back: later stages neither repeat the work before it
    nor depend on the executors that did it."""
    spark: SparkSession = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_runs(text: bytes, carry: int = 0) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece at a time; each run but the first begins with the last ``carry`` words
    before it."""
    start, tail = 0, []
    while start < len(text):
        end = min(start + PIECE, len(text))
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        words = tail + text[start:end].split()
        yield words
        tail = words[-carry:] if carry else []
        start = end


def row_keys(doc_id: str, text: str) -> list:
    """Two hashes that tell rows apart by id and text; neither is ever null."""
    return [F.xxhash64(F.col(doc_id), F.col(text)), F.xxhash64(F.lit(7), F.col(text), F.col(doc_id))]
