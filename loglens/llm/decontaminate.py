"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items.

Items and documents are normalised alike, to lower-case ASCII letters, digits and all non-ASCII characters. The automaton
runs over word numbers, so its size is that of the items' windows in words, and each text is scanned once. Matches are
spans of words, told as byte offsets of the original text.

The items are collected and broadcast, and their size is checked first: up to ``BLOCK_BYTES`` of text make one
automaton. More items are cut into blocks of that size, and every batch of documents is scanned by one block after the
other, so that a worker holds one automaton at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import as_bytes

WINDOW = 13
BLOCK_BYTES = 32 << 20
MIN_SHARE = 20  # contaminated if at least one word of so many is hit

_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NORMAL = bytes(c if c in _WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text."""
    return text.translate(_NORMAL).split()


class Items:
    """The automaton over the windows of some items. Matches carry the length in words and the items' numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, (_, text) in enumerate(items):
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for words, found in owners.items():
                self.automaton.add_word(words, (len(words), tuple(found)))
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first word, word after the last, items) of every occurrence."""
        if self.automaton is None or not words:
            return
        number = self.numbers.get
        for last, (length, found) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            yield last - length + 1, last + 1, found


_ready: dict[tuple, Items] = {}  # the automaton that this worker has at hand


def _scan(texts: list[bytes], blocks: list, window: int) -> Iterator[tuple[int, int, list[str], list[dict]]]:
    """Per text: words, words hit, named items, byte spans of the hits."""
    words = [words_of(t) for t in texts]
    hit: list[bytearray | None] = [None] * len(texts)
    named: list[set[str]] = [set() for _ in texts]
    for key, block in blocks:
        if key not in _ready:
            _ready.clear()
            _ready[key] = Items(block.value, window)
        items = _ready[key]
        for row, ws in enumerate(words):
            for low, high, found in items.matches(ws):
                if hit[row] is None:
                    hit[row] = bytearray(len(ws))
                hit[row][low:high] = b"\x01" * (high - low)
                named[row].update(items.names[i] for i in found if items.names[i] is not None)
    for text, ws, marks, names in zip(texts, words, hit, named, strict=True):
        spans = []
        if marks:
            places = [m.span() for m in _WORD.finditer(text)]
            for m in re.finditer(rb"\x01+", bytes(marks)):
                spans.append({"start": places[m.start()][0], "end": places[m.end() - 1][1]})
        yield len(ws), sum(marks or b""), sorted(names), spans


def collected_items(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> list[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text, read one block at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("binary").alias("body"))
    items = items.filter("body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-total // block_bytes)
    share = F.pmod(F.xxhash64("name", "body"), F.lit(n)) if n > 1 else F.lit(0)
    return [[(r.name, bytes(r.body)) for r in items.filter(share == i).collect()] for i in range(n)]


def scan_column(
    benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> Column:
    """A struct column (n_words, n_hit, items, spans) for the text column ``text`` of a table of documents.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; an item without words has none.
    ``items`` are the ids, as sorted text, of items with a window in the text; ``spans`` the hit words' byte offsets in
    the original. Null and empty texts have no words. Items with a null id count for hits and are not named; items with
    the same id are one; with no items nothing is hit.
    """
    context = benchmark.sparkSession.sparkContext
    blocks = collected_items(benchmark, item_id, item_text, block_bytes)
    shared = [((uuid.uuid4().hex, window), context.broadcast(block)) for block in blocks]

    @F.arrow_udf("struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>")
    def scan(texts: pa.Array) -> pa.Array:
        found = list(_scan(as_bytes(texts), shared, window))
        n_words, n_hit, items, spans = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            ["n_words", "n_hit", "items", "spans"],
        )

    return scan.asNondeterministic()(F.col(text).cast("binary"))  # or a filter on the result would scan twice


def is_contaminated(scan: str, min_share: int = MIN_SHARE) -> Column:
    n_hit, n_words = F.col(f"{scan}.n_hit"), F.col(f"{scan}.n_words")
    return (n_hit > 0) & (n_hit * min_share >= n_words)
