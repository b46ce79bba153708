"""The first copy of every text, by compressed tries over ranges of adaptive text prefixes.

Every task first puts its rows into tries of its own, whose terminals hold the least id of each text, so that of copies at
most one a task and trie travels. The texts are then dealt out by ranges of their prefixes: the bounds are as long as is
needed to part neighbours in a sample of the texts, so that ranges are alike in size where many texts begin alike. A
range that is too large for a trie, as one of texts with a very long common beginning, is dealt on into slots by a hash of
the whole text. Each (range, slot) becomes one trie of bounded size, and its terminals tell the first copy of each text.

The sample sets bounds only; any bounds give the same rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import as_bytes

TRIE_BYTES = 16 << 20  # of different text in one trie, about
RANGES = 1024  # at most; larger tables get more slots a range
SAMPLES = 16  # texts a range in the sample
PREFIX = 512  # bytes of a sampled text
_NODE = 200  # bytes that a node takes besides its edge, about
_BATCH = 4 << 20  # bytes of text in one batch of rows


class Node:
    __slots__ = ("edge", "next", "first")

    def __init__(self, edge: bytes):
        self.edge, self.next, self.first = edge, {}, None


def _shared(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of an edge stand in the text at ``at``; the edge as a whole does not."""
    low, high = 0, len(edge) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie of whole texts; its terminals hold the least id of a text, a value of the text, and the number
    of rows with that id by part."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def _end(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.next.get(text[at])
            if child is None:
                child = node.next[text[at]] = Node(text[at:])
                self.size += _NODE + len(child.edge)
            elif not text.startswith(child.edge, at):
                n = _shared(child.edge, text, at)
                middle = node.next[text[at]] = Node(child.edge[:n])
                child.edge = child.edge[n:]
                middle.next[child.edge[0]] = child
                child = middle
                self.size += _NODE
            node, at = child, at + len(child.edge)
        return node

    def insert(self, text: bytes, doc_id: int, value: int | Callable[[bytes], int], part: str, n: int = 1) -> None:
        """``value`` is that of the text, or a function that is called where the text is new."""
        node = self._end(text)
        if node.first is None:
            node.first = [doc_id, value(text) if callable(value) else value, {part: n}]
            self.size += _NODE
        elif doc_id < node.first[0]:
            node.first = [doc_id, node.first[1], {part: n}]
        elif doc_id == node.first[0]:
            parts = node.first[2]
            parts[part] = parts.get(part, 0) + n

    def walk(self) -> Iterator[tuple[bytes, int, int, str, int]]:
        """(text, id, value, part, n) of every terminal."""
        left = [(self.root, b"")]
        while left:
            node, text = left.pop()
            text += node.edge
            if node.first is not None:
                doc_id, value, parts = node.first
                for part, n in parts.items():
                    yield text, doc_id, value, part, n
            left.extend((child, text) for child in node.next.values())


@dataclass(frozen=True)
class Ranges:
    """Sorted prefixes between ranges, and the slots of each range."""

    bounds: tuple[bytes, ...]
    slots: tuple[int, ...]

    def of(self, text: bytes) -> tuple[int, int]:
        at = bisect_right(self.bounds, text)
        return at, xxhash.xxh64_intdigest(text) % self.slots[at] if self.slots[at] > 1 else 0


def _parting(before: bytes, prefix: bytes) -> bytes:
    """The shortest beginning of ``prefix`` that is beyond ``before``."""
    n = next((i for i, (a, b) in enumerate(zip(before, prefix, strict=False)) if a != b), min(len(before), len(prefix)))
    return prefix[: n + 1]


def cut_ranges(sample: list[tuple[bytes, float]], n_ranges: int, trie_bytes: float = TRIE_BYTES) -> Ranges:
    """About ``n_ranges`` ranges of like weight from prefixes with weights in bytes."""
    sample = sorted(sample)
    step = sum(w for _, w in sample) / n_ranges
    bounds, filled = [], 0.0
    for (before, weight), (prefix, _) in pairwise(sample):
        filled += weight
        if filled >= step and before != prefix:
            bounds.append(_parting(before, prefix))
            filled = 0.0
    held = [0.0] * (len(bounds) + 1)
    for prefix, weight in sample:
        held[bisect_right(bounds, prefix)] += weight
    return Ranges(tuple(bounds), tuple(max(1, -int(-w // trie_bytes)) for w in held))


def find_ranges(docs: DataFrame, text: str, trie_bytes: int = TRIE_BYTES, ranges: int = RANGES) -> Ranges:
    """Ranges from the beginnings of at most about ``SAMPLES * ranges`` different texts, chosen by their hash."""
    share = min(1.0, SAMPLES * ranges / max(1, docs.count()))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    found = docs.select(F.xxhash64(body).alias("hash"), F.substring(body, 1, PREFIX).alias("prefix"), F.octet_length(body).alias("n"))
    if share < 1:
        found = found.filter(F.col("hash") < int(share * 2**64) - 2**63)
    rows = found.groupBy("hash").agg(F.first("prefix").alias("prefix"), F.max("n").alias("n")).toArrow()
    weights = [(n + _NODE) / share for n in rows.column("n").to_pylist()]
    sample = list(zip(rows.column("prefix").to_pylist(), weights, strict=True))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_ranges(sample, int(min(ranges, max(sum(weights) // trie_bytes, 4 * tasks))), trie_bytes)


_TEXTS = "range int, slot int, body binary, doc_id bigint, value int, part string, n bigint"
_FIRSTS = "doc_id bigint, value int, part string, n bigint"


def _own_tries(ranges: Ranges, judge: Callable[[bytes], int], trie_bytes: int):
    schema = pa.schema(
        [("range", pa.int32()), ("slot", pa.int32()), ("body", pa.binary()), ("doc_id", pa.int64()), ("value", pa.int32()),
         ("part", pa.string()), ("n", pa.int64())]
    )

    def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for text, *rest in trie.walk():
            rows.append((*ranges.of(text), text, *rest))
            held += len(text)
            if held > _BATCH or len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for doc_id, part, body in zip(ids, parts, as_bytes(batch.column("body")), strict=True):
                trie.insert(body, doc_id, judge, part)
                if trie.size > trie_bytes:
                    yield from emptied(trie)
                    trie = Trie()
        yield from emptied(trie)

    return run


def _range_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and slot: one trie at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("value", pa.int32()), ("part", pa.string()), ("n", pa.int64())])

    def firsts(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows = [row[1:] for row in trie.walk()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    trie, at = Trie(), None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("range", "slot", "body", "doc_id", "value", "part", "n"))
        for low, slot, body, doc_id, value, part, n in zip(*columns, strict=True):
            if (low, slot) != at:
                yield from firsts(trie)
                trie, at = Trie(), (low, slot)
            trie.insert(body, doc_id, value, part, n)
    yield from firsts(trie)


def first_copies(
    docs: DataFrame, judge: Callable[[bytes], int], doc_id: str = "doc_id", text: str = "text", part: str = "part",
    trie_bytes: int = TRIE_BYTES, ranges: int = RANGES,
) -> DataFrame:
    """(doc_id, value, part, n): the least id of every text, what ``judge`` says of the text, and the number of rows of
    each part that have this id and text. Null texts are empty ones; rows with a null id are no first copies."""
    rows = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(part).alias("part"), F.col(text).cast("binary").alias("body")
    )
    found = find_ranges(docs, text, trie_bytes, ranges)
    own = rows.mapInArrow(_own_tries(found, judge, trie_bytes), _TEXTS)
    dealt = own.repartition("range", "slot").sortWithinPartitions("range", "slot")
    return dealt.mapInArrow(_range_tries, _FIRSTS)
