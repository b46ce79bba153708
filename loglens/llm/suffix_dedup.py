"""Removal of repeated byte strings by phrases of the text, with hash grouping in place of suffix arrays.

Rolling-hash triggers cut documents into phrases (``parsing.py``), as in prefix-free parsing, but neither the suffix array of
the dictionary nor that of the parse is built, and there is no corpus order. Only whether ``WIDTH`` bytes occur elsewhere is
looked for, and equal hashes tell that without an order:

1. A phrase's core, a fixed number of bytes from its trigger, lies in all its windows. Cores that occur once need no
   further look; these are most phrases of text that isn't repetitive.
2. Phrases equal in full are one dictionary entry; all windows of an entry that occurs twice are repeated.
3. Entries that share a core but differ are compared window by window, each entry once however often it occurs.

Between stages go hashes of phrases, not windows; only entries of step 3 carry text, of some 250 bytes each.
A core shared by more than ``GROUP_LIMIT`` different entries is not gathered in a task: its windows are counted
by a shuffle instead, which starts in every task. Both ways give the same windows. Hashes of two kinds make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.parsing import phrases, window_hashes
from loglens.llm.shared import stored

WIDTH = 200
CORE = 48
GROUP_LIMIT = 8192
SALTS = 16
HOT_ENTRIES = 1000  # entries at most that all tasks get, being those with most copies
_ENTRY = ["doc_id", "body_hash", "start", "starts", "core", "whole", "copies"]
_WINDOWS = 1 << 19  # windows compared at once


def _concatenated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and the ends of its values."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return joined, (offsets[1:] - offsets[0]).astype(np.int64)


def _parser(width: int, core: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = _concatenated(batch.column("body"))
            for doc, start, starts, cores, wholes, _ in phrases(data, ends, width, core):
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("body_hash").take(rows),
                        pa.array(start.astype(np.int32)),
                        pa.array(starts.astype(np.int32)),
                        pa.array(cores.view(np.int64)),
                        pa.array(wholes.view(np.int64)),
                    ],
                    ["doc_id", "body_hash", "start", "starts", "core", "whole"],
                )

    return parse


def _windows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash) of all windows of the entries of a batch."""
    data, ends = _concatenated(batch.column("entry"))
    if len(data) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64)
    lengths = np.diff(np.concatenate([[0], ends]))
    count = np.maximum(lengths - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offset + (ends - lengths)[row]
    hashes = np.empty(len(row), np.uint64)
    step = 1 << 16
    for low in range(0, len(data) - width + 1, step):
        some = slice(*np.searchsorted(at, [low, low + step]))
        if some.stop > some.start:
            hashes[some] = window_hashes(data[low : low + step + width - 1], width)[at[some] - low]
    return row, offset, hashes


def _compare(batch: pa.RecordBatch, width: int) -> pa.RecordBatch | None:
    """Repeated runs of starts in entries that occur once, for whole groups of entries sorted by core."""
    cores = batch.column("core").to_numpy()
    wholes = batch.column("whole").to_numpy()
    same = np.zeros(len(cores), bool)  # a repeated row of a table makes an entry come twice
    order = np.lexsort((wholes, cores))
    same[order[1:]] = (cores[order[1:]] == cores[order[:-1]]) & (wholes[order[1:]] == wholes[order[:-1]])
    batch = batch.filter(pa.array(~same))
    cores = batch.column("core").to_numpy()
    row, offset, hashes = _windows(batch, width)
    if not len(row):
        return None
    order = np.lexsort((hashes, cores[row]))
    equal = (hashes[order[1:]] == hashes[order[:-1]]) & (cores[row[order[1:]]] == cores[row[order[:-1]]])
    found = np.zeros(len(row), bool)
    found[order[1:]] |= equal
    found[order[:-1]] |= equal
    found &= (batch.column("copies").to_numpy() == 1)[row]
    opens = found.copy()
    opens[1:] &= ~(found[:-1] & (row[1:] == row[:-1]))
    closes = found.copy()
    closes[:-1] &= ~(found[1:] & (row[1:] == row[:-1]))
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    if not len(first):
        return None
    rows = pa.array(row[first])
    start = batch.column("start").to_numpy()[row[first]]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(rows),
            batch.column("body_hash").take(rows),
            pa.array((start + offset[first]).astype(np.int32)),
            pa.array((last - first + 1).astype(np.int32)),
        ],
        ["doc_id", "body_hash", "start", "starts"],
    )


def _comparer(width: int):
    """Compares entries that come sorted by core, a bounded number of whole groups at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held["starts"].to_numpy().sum() < _WINDOWS:
                continue
            cores = held["core"].to_numpy()
            whole = int(np.flatnonzero(cores != cores[-1])[-1]) + 1 if cores[0] != cores[-1] else 0
            if whole:
                yield from filter(None, [_compare(held.slice(0, whole).combine_chunks().to_batches()[0], width)])
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from filter(None, [_compare(held.combine_chunks().to_batches()[0], width)])

    return compare


def _exploder(width: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                some = batch.slice(low, 2048)
                row, offset, hashes = _windows(some, width)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [some.column(c).take(rows) for c in ("doc_id", "body_hash")]
                    + [
                        pa.array((some.column("start").to_numpy()[row] + offset).astype(np.int32)),
                        *[some.column(c).take(rows) for c in ("core", "whole", "copies")],
                        pa.array(hashes.view(np.int64)),
                    ],
                    ["doc_id", "body_hash", "start", "core", "whole", "copies", "window"],
                )

    return explode


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("body_hash"), body.alias("body"))


def _same_document(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["body_hash"] == right["body_hash"])


def repeated_runs(bodies: DataFrame, width: int = WIDTH, core: int = CORE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, body_hash, start, starts): runs of window starts whose ``width`` bytes also start elsewhere, for
    (doc_id, body_hash, body). Rows equal in id and text share their runs."""
    kind = bodies.schema["doc_id"].dataType.simpleString()
    runs_schema = f"doc_id {kind}, body_hash bigint, start int, starts int"
    parsed = bodies.filter(F.octet_length("body") >= width).mapInArrow(
        _parser(width, core), runs_schema + ", core bigint, whole bigint"
    )
    cores = parsed.groupBy("core").agg(
        F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")
    )
    cores = cores.filter("n > 1").select("core", (F.col("low") != F.col("high")).alias("varied"))
    # Written first: a join of two plain shuffles can be split where one core has very many phrases.
    hits = stored(parsed.join(stored(cores, "cores"), "core"), "phrases")
    alike = hits.filter("not varied")

    place = F.struct("doc_id", "body_hash", "start", "starts")
    entries = (
        hits.filter("varied").groupBy("core", "whole").agg(F.count("*").alias("copies"), F.min(place).alias("place"))
    )
    entries = stored(entries, "entries")
    # Of n phrases, at most HOT_ENTRIES entries have more than n / HOT_ENTRIES each; their copies are found where they are.
    varied, key = hits.filter("varied"), ["core", "whole"]
    total = entries.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(entries.filter(F.col("copies") > max(1, total // HOT_ENTRIES)).select(*key))
    others = varied.join(hot, key, "left_anti").join(entries.filter("copies > 1").select(*key), key, "left_semi")
    copied = varied.join(hot, key, "left_semi").unionByName(others)

    large = entries.groupBy("core").agg(F.count("*").alias("size")).filter(F.col("size") > group_limit).select("core")
    large = stored(large, "large")  # at most the entries divided by the limit
    few, many = entries.join(large, "core", "left_anti"), entries.join(large, "core", "left_semi")

    def told(some: DataFrame) -> DataFrame:
        placed = some.select("core", "whole", "copies", "place.*")
        return bodies.join(placed, _same_document(bodies, placed)).select(
            *[placed[c] for c in _ENTRY],
            F.substring(bodies["body"], F.col("start") + 1, F.col("starts") + width - 1).alias("entry"),
        )

    compared = told(few).repartition("core").sortWithinPartitions("core").mapInArrow(_comparer(width), runs_schema)
    windows = told(many).dropDuplicates(["core", "whole"]).mapInArrow(
        _exploder(width),
        f"doc_id {kind}, body_hash bigint, start int, core bigint, whole bigint, copies bigint, window bigint",
    )
    often = windows.groupBy("core", "window").agg(F.count("*").alias("n")).filter("n > 1").select("core", "window")
    # A window that very many entries share is found by each of them, so its rows are dealt out by salts.
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    once = windows.filter("copies = 1").withColumn("salt", F.pmod(F.xxhash64("whole"), F.lit(SALTS)).cast("int"))
    counted = once.join(often, ["core", "window", "salt"], "left_semi").withColumn("starts", F.lit(1))
    columns = ["doc_id", "body_hash", "start", "starts"]
    found = [alike.select(*columns), copied.select(*columns), compared, counted.select(*columns)]
    return reduce(DataFrame.union, found)


def _without(text: bytes, opens: list[int] | None, closes: list[int] | None) -> tuple[bytes, list[dict]]:
    """The bytes outside the spans, and the spans merged."""
    if not opens:
        return text, []
    order = np.argsort(opens, kind="stable")
    low, reach = np.array(opens, np.int64)[order], np.maximum.accumulate(np.array(closes, np.int64)[order])
    gaps = np.flatnonzero(low[1:] > reach[:-1])
    firsts, lasts = low[np.append(0, gaps + 1)].tolist(), reach[np.append(gaps, len(reach) - 1)].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *lasts], [*firsts, len(text)], strict=True))
    return kept, [{"start": a, "end": b} for a, b in zip(firsts, lasts, strict=True)]


def _cut(body: Column, opens: Column, closes: Column) -> Column:
    @F.arrow_udf("struct<kept:binary,removed:array<struct<start:int,end:int>>>")
    def cut(bodies: pa.Array, opens: pa.Array, closes: pa.Array) -> pa.Array:
        done = list(map(_without, bodies.to_pylist(), opens.to_pylist(), closes.to_pylist()))
        spans = pa.array([d[1] for d in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.binary()), spans], ["kept", "removed"])

    return cut.asNondeterministic()(body, opens, closes)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """(doc_id, n_bytes, kept, removed) per row: the text's bytes without those covered by a string of ``width`` bytes
    that also starts elsewhere, in this document or another, and the removed runs as byte offsets.

    A null text counts as empty; a text shorter than ``width`` is kept whole. Every copy is removed, also the first. Rows
    with null or repeated ids are judged by their own text. An empty table gives no rows; other columns are not read.
    """
    bodies = _bodies(docs, doc_id, text)
    runs = repeated_runs(bodies, width, group_limit=group_limit)
    # Each copy of a row has the same runs, so a set of them is as long as those of one.
    spans = runs.groupBy("doc_id", "body_hash").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("starts") + width - 1).alias("end"))).alias("spans")
    )
    cut = bodies.join(spans, _same_document(bodies, spans), "left").select(
        bodies["doc_id"].alias(doc_id),
        F.octet_length("body").cast("bigint").alias("n_bytes"),
        _cut(F.col("body"), F.col("spans.start"), F.col("spans.end")).alias("cut"),
    )
    return cut.select(doc_id, "n_bytes", "cut.kept", "cut.removed")


