"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A pattern splits a text into pre-tokens, and each pre-token is encoded by a vocabulary of ranked byte strings, as the
tiktoken library would do it. A text of more than ``chunk`` code points is dealt out as chunks that overlap the next one:

1. Chunks are split into pre-tokens in parallel, each from its own start, which may lie within a pre-token.
2. Neighbours are stitched at the first place of their overlap where both have a boundary. How a text is split after a
   boundary depends on nothing before it, so if the boundaries of the first chunk are right, and those of every chunk meet
   the next one's, then all are right from these places on.
3. The pieces between the places are encoded in parallel, and the ids of a text are put together in order.

A text in which some overlap has no common boundary, such as a single run of letters longer than it, is encoded as one
piece. Decoding concatenates the bytes of the ids.

Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD. Rows repeat as they do in the input, extra columns
are kept whatever their names are, and an empty table gives an empty one.

Spark gives a worker up to 10,000 texts at once, whose ids take more memory than they do. Workers therefore give back ids and
bytes in runs of rows that have about ``RUN`` ids, before they take up the next ones.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.shared import own_name, stored

CHUNK = 1 << 16  # code points of a chunk besides its overlap
OVERLAP = 1 << 10
#: Code points after a pre-token on which the pattern may decide where it ends; those nearer to a cut are not trusted.
LOOKAHEAD = 16
MAX_FILE = 64 << 20  # bytes of a vocabulary file, which is broadcast
KEPT = 1 << 16  # pre-tokens whose ids a worker keeps at hand
KEPT_CHARS = 48
RUN = 1 << 18  # ids that a worker holds, besides those of its last row, before it gives them back


@dataclass(frozen=True)
class Vocabulary:
    """The text of a file of ranks and the pattern that splits texts, as workers get them."""

    ranks: Broadcast
    pattern: str
    key: str


def load(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """A vocabulary from a file of lines ``<base64 bytes> <rank>`` on the driver, from which the executors get it."""
    size = os.path.getsize(path)
    if size > MAX_FILE:
        raise ValueError(f"{path} has {size} bytes; a vocabulary may have {MAX_FILE}")
    with open(path, "rb") as file:
        return Vocabulary(spark.sparkContext.broadcast(file.read()), pattern, f"{path}|{size}|{os.path.getmtime(path)}")


def rank_table(ranks: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Codec:
    def __init__(self, ranks: bytes, pattern: str):
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank_table(ranks), special_tokens={})
        self.known: dict[str, tuple[int, ...]] = {}

    def ids(self, pre_tokens: Iterable[str]) -> array:
        """The ids of pre-tokens, each encoded by itself."""
        out, known, merge = array("i"), self.known, self.encoding._encode_single_piece
        for piece in pre_tokens:
            ids = known.get(piece)
            if ids is None:
                ids = tuple(merge(piece))
                if len(piece) <= KEPT_CHARS:
                    if len(known) >= KEPT:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def ends(self, text: str) -> Iterator[int]:
        """Where the pre-tokens of a text end."""
        return (m.end() for m in self.split.finditer(text))


_ready: dict[tuple[str, str], Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    key = vocabulary.key, vocabulary.pattern
    if key not in _ready:
        _ready.clear()
        _ready[key] = Codec(vocabulary.ranks.value, vocabulary.pattern)
    return _ready[key]


_bytes: dict[str, dict[int, bytes]] = {}


def _bytes_of(vocabulary: Vocabulary) -> dict[int, bytes]:
    if vocabulary.key not in _bytes:
        _bytes.clear()
        _bytes[vocabulary.key] = {rank: token for token, rank in rank_table(vocabulary.ranks.value).items()}
    return _bytes[vocabulary.key]


def _texts(column: pa.Array) -> Iterator[str]:
    return ((x.as_py() or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()))


def _lists(rows: Iterable[array]) -> Iterator[pa.Array]:
    """Rows of ids in runs."""
    flat, ends = array("i"), [0]
    for row in rows:
        flat.extend(row)
        ends.append(len(flat))
        if len(flat) >= RUN:
            yield _list_array(flat, ends)
            flat, ends = array("i"), [0]
    if len(ends) > 1:
        yield _list_array(flat, ends)


def _list_array(flat: array, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32), pa.int32()))


def whole_texts(text: str, vocabulary: Vocabulary) -> Column:
    """The ids of each text, encoded in one go."""

    @F.arrow_udf("array<int>")
    def encode_whole(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(vocabulary)
        for column in columns:
            yield from _lists(codec.ids(codec.split.findall(t)) for t in _texts(column))

    return encode_whole.asNondeterministic()(F.col(text).cast("binary"))  # or each use of the ids would encode again


def meeting(codec: Codec, text: str, chunk: int, overlap: int, lookahead: int = LOOKAHEAD) -> int | None:
    """Where the pre-tokens of a chunk first have a boundary in common with those of the next one, which begins at
    ``chunk``; none if they do not meet within the overlap."""
    last = chunk + overlap - lookahead
    own = {end for end in codec.ends(text) if chunk <= end <= last}
    if chunk in own:
        return chunk
    return next((chunk + end for end in codec.ends(text[chunk:]) if chunk + end in own), None)


def _cutter(chunk: int, overlap: int):
    """Chunks ``row, part, body`` of texts; the last one has what is left, and no next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), _texts(batch.column("body")), strict=True):
                n = max(1, -(-(len(text) - overlap) // chunk))
                for part in range(n):
                    end = (part + 1) * chunk + overlap if part < n - 1 else len(text)
                    body = text[part * chunk : end].encode()
                    yield pa.RecordBatch.from_pydict({"row": [row], "part": [part], "body": [body], "last": [part == n - 1]}, _CUT)

    return cut


_CUT = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("body", pa.binary()), ("last", pa.bool_())])


def _chunked(numbered: DataFrame, text: str, vocabulary: Vocabulary, chunk: int, overlap: int, name: str) -> DataFrame:
    """(row, name) with the ids of long texts."""
    bodies = numbered.select(F.col("row"), F.col(text).cast("binary").alias("body"))
    cut = bodies.mapInArrow(_cutter(chunk, overlap), "row bigint, part int, body binary, last boolean")
    chunks = cut.repartition("row", "part")

    @F.arrow_udf("int")
    def meet(column: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return pa.array([meeting(codec, t, chunk, overlap) for t in _texts(column)], pa.int32())

    @F.arrow_udf("array<int>")
    def encode_piece(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = _codec(vocabulary)

        def pieces(text: str, low: int, high: int | None) -> Iterator[str]:
            text = text[low:]
            at, stop = 0, len(text) if high is None else high - low
            for m in codec.split.finditer(text):
                if at >= stop:
                    break
                yield m[0]
                at = m.end()
            if at != stop:
                raise ValueError("the pattern decides by more code points after a pre-token than LOOKAHEAD")

        for column, low, high in columns:
            rows = zip(_texts(column), low.to_pylist(), high.to_pylist(), strict=True)
            yield from _lists(codec.ids(pieces(*row)) for row in rows)

    # The places are narrow and written, so that chunks are split once more at the most, to be encoded.
    places = chunks.select("row", "part", F.when(~F.col("last"), meet("body")).alias("high"), "last")
    places = stored(places, "bpe-places")
    by_row = Window.partitionBy("row")
    before = F.lag("high").over(by_row.orderBy("part")) - chunk
    stitched = places.select(
        "row", "part", "high", F.coalesce(before, F.lit(0)).alias("low"),
        F.max(F.col("high").isNull() & ~F.col("last")).over(by_row).alias("apart"),
    )
    pieces = chunks.join(stitched.filter(~F.col("apart")), ["row", "part"])
    pieces = pieces.select("row", "part", encode_piece("body", "low", "high").alias("ids"))
    joined = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    whole = bodies.join(stitched.filter(F.col("apart") & (F.col("part") == 0)).select("row"), "row", "left_semi")
    return joined.select("row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias(name)).unionByName(
        whole.select("row", whole_texts("body", vocabulary).alias(name))
    )


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "token_ids",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with the ids of the whole texts as ``name``. Long texts are written once with a number, by which their
    pieces are told apart whatever the ids of the documents are."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    if not LOOKAHEAD < overlap <= chunk:
        raise ValueError(f"an overlap is longer than {LOOKAHEAD} and no longer than a chunk")
    long = F.coalesce(F.char_length(text) > chunk + overlap, F.lit(False))
    short = docs.filter(~long).withColumn(name, whole_texts(text, vocabulary))
    row = own_name(docs, "row")
    numbered = stored(docs.filter(long).withColumn(row, F.monotonically_increasing_id()), "bpe-long")
    ids = _chunked(numbered.select(F.col(row).alias("row"), F.col(text).alias("body")), "body", vocabulary, chunk, overlap, name)
    found = numbered.join(ids.withColumnRenamed("row", row), row).drop(row)
    return short.unionByName(found.select(*short.columns))


def _runs(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of the rows of a column of lists."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = before = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, before + RUN, "right")))
        yield column.slice(low, high - low)
        low, before = high, ends[high - 1]


def _bounds(column: pa.Array) -> Iterator[tuple[int, int] | None]:
    """Where the rows of a column of lists lie in its flat values; none for null."""
    ends = np.cumsum([0, *(n or 0 for n in column.value_lengths().to_pylist())]).tolist()
    for valid, low, high in zip(column.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True):
        yield (low, high) if valid else None


def _decoded(column: pa.Array, token: dict[int, bytes]) -> pa.Array:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = (at and b"".join(map(token.__getitem__, flat[at[0] : at[1]].tolist())) for at in _bounds(column))
    return pa.array(rows, pa.binary())


def _packed(column: pa.Array) -> pa.Array:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    return pa.array((at and flat[4 * at[0] : 4 * at[1]] for at in _bounds(column)), pa.binary())


def decode(ids: str, vocabulary: Vocabulary) -> Column:
    """The bytes of the ids of a column, concatenated; null stays null. An id that the vocabulary lacks is an error."""

    @F.arrow_udf("binary")
    def decode_ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _bytes_of(vocabulary)
        for column in columns:
            yield from (_decoded(run, token) for run in _runs(column))

    return decode_ids(ids)


def packed(ids: str) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def pack(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from map(_packed, _runs(column))

    return pack(ids)


def packed_and_decoded(ids: str, vocabulary: Vocabulary) -> Column:
    """``packed`` and ``decoded`` of a struct, as ``packed`` and ``decode`` give them, for which ids go to one worker only."""

    @F.arrow_udf("packed binary, decoded binary")
    def pack_and_decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _bytes_of(vocabulary)
        for column in columns:
            for run in _runs(column):
                yield pa.StructArray.from_arrays([_packed(run), _decoded(run, token)], ["packed", "decoded"])

    return pack_and_decode.asNondeterministic()(ids)  # or each of the two would do both again
