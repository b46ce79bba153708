"""Alignment of the tokens of two tokenizers, each different text done once.

Texts are shuffled as a whole, so that copies meet; a different text is tokenised by both tokenizers and aligned once, and its
pair counts are weighted by its number of copies. The measures of texts go to the documents by a digest of the text.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut them into groups; tokens of which a byte is the
same are linked. An id pair's count is the number of links of the whole corpus between these ids.

The pairs of each text are written with its measures. Counts of pairs are joined in two ways: the ``HEAD`` most frequent pairs
are sent to all tasks, which find most links there, and the pairs beyond them are shuffled, so no pair is left out and what is
sent is bounded.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: their measures are zeros, and
the digest of the groups is empty. A text is worked on in units, cut at single spaces where neither tokenizer joins anything, so
that both end a token there; within a block of texts a unit that comes again is tokenised once, and a worker keeps a bounded number of
short units at hand. A task's memory is that of a block, or of one text that is longer.

Units of ASCII and Latin letters are tokenised many on a line, and by A with tiktoken's merges. Those give the same tokens where each
merge makes a token of its own, in the order of their ids, and each token alone is tokenised as itself: two tokens stand side by side
before a merge only if they do so where their bytes are alone, so no pair but that of the merge is ever joined to its token. The
driver looks whether this holds (``merges_by_rank``); else, and for all other units, A's own library does it.
Rows repeat as in the input, null ids are kept, extra columns are not used, an empty table gives an empty one.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.shared import stored

HEAD = 1 << 18  # id pairs that all tasks get with their counts
BLOCK = 1 << 19  # code points of the texts that are worked on at once
KNOWN = 1 << 16  # aligned units of a generation that a worker keeps at hand; there are two
KNOWN_CHARS = 24
UNITS = 1 << 13  # units that a tokenizer gets at once
LINE = 16  # units that B gets on a line
MAX_UNIT = 512  # code points of a unit that is put on a line with others
HOT_KEYS = 1000  # texts at most whose copies are dealt out by salts
MAX_FILE = 64 << 20  # bytes of a tokenizer file
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"  |\s \s|^ | $")
# ASCII and Latin letters, whose classes all versions of Unicode agree on; no space at either end.
_SEEN = r"!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_PLAIN = re.compile(rf"[{_SEEN}](?:[\n {_SEEN}]{{0,{MAX_UNIT - 2}}}[{_SEEN}])?")
#: The fixed pattern of byte-level pre-tokens.
_PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
LINKED = ("n_best", "count_sum")
KEPT = ("key", "copies", *MEASURES, "groups_sha256")


@dataclass(frozen=True)
class Pair:
    """The files of a byte-level BPE (A) and of a piece model with byte fallback (B), as workers get them."""

    a: Broadcast
    b: Broadcast
    key: str
    by_rank: bool  # whether A's tokens can be had from tiktoken


def load(spark: SparkSession, path_a: str, path_b: str) -> Pair:
    """Both files are read on the driver; executors get them from there."""
    files = []
    for path in (path_a, path_b):
        if os.path.getsize(path) > MAX_FILE:
            raise ValueError(f"{path} has more than {MAX_FILE} bytes")
        with open(path, "rb") as file:
            files.append(spark.sparkContext.broadcast(file.read()))
    return Pair(*files, uuid.uuid4().hex, merges_by_rank(files[0].value))


def byte_table() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies of byte-level BPE: printable ones for themselves, the others for the
    code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def own_library(file_a: bytes) -> tokenizers.Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have a core each
    a = tokenizers.Tokenizer.from_str(file_a.decode())
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a


def merges_by_rank(file_a: bytes) -> bool:
    """Whether joining the neighbours whose bytes are the token with the least id does the merges of the file."""
    whole = json.loads(file_a)
    model, cutter = whole["model"], whole.get("pre_tokenizer") or {}
    plain = whole.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    if not plain or cutter.get("add_prefix_space") or model.get("type") != "BPE" or any(model.get(c) for c in odd):
        return False
    vocabulary, letters = model["vocab"], byte_table()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[left + right] for left, right in merges]
    special = {t["content"] for t in whole.get("added_tokens") or []}
    tokens = {t: i for t, i in vocabulary.items() if t not in special}
    if not all(c in tokens for c in letters) or not all(c in letters for t in tokens for c in t) or ids != sorted(set(ids)) or len(tokens) != len(letters) + len(ids):
        return False
    if ids and max(tokens[c] for c in letters) > ids[0]:
        return False
    own = own_library(file_a).model
    return all([x.id for x in own.tokenize(t)] == [i] for t, i in tokens.items())


class Aligner:
    def __init__(self, file_a: bytes, file_b: bytes, by_rank: bool = False):
        self.file_a = file_a
        letters = byte_table()
        whole = json.loads(file_a)
        vocabulary, special = whole["model"]["vocab"], {t["id"] for t in whole.get("added_tokens") or []}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # Special tokens are no byte texts, and are never used.
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        self.ranked = None
        if by_rank:
            ranks = {x: i for i, x in enumerate(self.bytes_a) if x and i not in special}
            self.ranked = tiktoken.Encoding("a", pat_str=_PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
            else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.names = [str(i) for i in range(max(n, len(self.bytes_a)))]
        # A piece that goes on with a space after another letter could cross a cut.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: tuple[dict, dict] = {}, {}

    @cached_property
    def a(self) -> tokenizers.Tokenizer:
        return own_library(self.file_a)

    def units(self, text: str) -> list[str]:
        """Parts of a text without the space before each, which A gets as text and B adds itself. At a space between other
        letters a pre-token of A ends, and no piece of B goes on."""
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _OTHER_SPACE.search(text) else text.split(" ")

    def on_a_line(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
        """The ids of both and their numbers per unit, of plain units; none if B does not give them back."""
        line = " " + " ".join(units)
        whole = line.encode()
        long = [len(u) for u in units] if len(whole) == len(line) else [len(u.encode()) for u in units]
        stops = np.cumsum(np.array(long, np.int64) + 1)
        found_b = self.b.encode([" ".join(units[i : i + LINE]) for i in range(0, len(units), LINE)], num_threads=1)
        flat = list(chain.from_iterable(found_b))
        if b"".join(map(self.bytes_b.__getitem__, flat)) != whole:
            return None
        found, sizes = [self.ranked.encode_to_numpy(line, disallowed_special=()).astype(np.int64), np.array(flat, np.int64)], []
        for ids, widths in zip(found, (self.sizes_a, self.sizes_b), strict=True):
            ends = np.cumsum(widths[ids])
            last = np.searchsorted(ends, stops)
            if (ends[last] != stops).any():
                return None
            sizes.append(np.diff(last, prepend=-1))
        return found, sizes

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B one after the other, the numbers of tokens per unit, and which units are given back; the tokens of
        others are left out."""
        ids, sizes, good = ([], []), ([], []), []
        for low in range(0, len(units), UNITS):
            some = units[low : low + UNITS]
            if self.ranked and self.cuts and all(map(_PLAIN.fullmatch, some)) and (lines := self.on_a_line(some)):
                for side, (found, size) in enumerate(zip(*lines, strict=True)):
                    ids[side].append(found)
                    sizes[side].append(size)
                good.append(np.ones(len(some), bool))
                continue
            whole = [b" " + u.encode() for u in some]
            bytes_of = [len(x) for x in whole]
            found_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in some], add_special_tokens=False)]
            found_b = self.b.encode(some, num_threads=1)
            back = np.ones(len(some), bool)
            for found, table, widths in ((found_a, self.bytes_a, self.sizes_a), (found_b, self.bytes_b, self.sizes_b)):
                flat = list(chain.from_iterable(found))
                ends = np.cumsum([len(x) for x in found])
                starts = np.concatenate([[0], np.cumsum(widths[flat])])
                if b"".join(map(table.__getitem__, flat)) != b"".join(whole) or (np.diff(starts[np.append(0, ends)]) != bytes_of).any():
                    back &= [b"".join([table[i] for i in f]) == w for f, w in zip(found, whole, strict=True)]
            for side, found in enumerate((found_a, found_b)):
                if not back.all():
                    found = [f if g else [] for f, g in zip(found, back.tolist(), strict=True)]
                ids[side].append(np.fromiter(chain.from_iterable(found), np.int64))
                sizes[side].append([len(f) for f in found])
            good.append(back)
        if not good:
            return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool)
        return *map(np.concatenate, ids), *map(np.concatenate, sizes), np.concatenate(good)

    def aligned_units(self, units: list[str]) -> list[tuple | None]:
        """Per unit none, or (n_a, n_b, n_groups, n_links, groups, links), the links as bytes of pairs of ids."""
        ids_a, ids_b, n_a, n_b, good = self.tokens(units)
        # All units on one line of bytes: between two ends of either kind lies one token of each, and another pair than in the
        # stretch before. Both tokenizers end a token at the end of a unit.
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        owner = np.repeat(np.arange(len(units)), n_a)[at_a]
        n_links = np.bincount(owner, minlength=len(units))
        n_groups = np.bincount(owner[both], minlength=len(units))

        names_a, names_b = ([self.names[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        groups, i, j = [], 0, 0
        for to_a, to_b in zip((at_a[both] + 1).tolist(), (at_b[both] + 1).tolist(), strict=True):
            if to_a - i == 1 == to_b - j:
                groups.append(names_a[i] + "|" + names_b[j])
            else:
                groups.append(",".join(names_a[i:to_a]) + "|" + ",".join(names_b[j:to_b]))
            i, j = to_a, to_b
        links = np.stack([ids_a[at_a], ids_b[at_b]], axis=1).astype(np.int32).tobytes()
        out, group, link = [], 0, 0
        for a, b, g, n, back in zip(*(x.tolist() for x in (n_a, n_b, n_groups, n_links, good)), strict=True):
            out.append((a, b, g, n, ";".join(groups[group : group + g]), links[8 * link : 8 * (link + n)]) if back else None)
            group, link = group + g, link + n
        return out

    def known_units(self, units: list[str]) -> list[tuple | None]:
        """The same, of which those at hand are not worked on again. A full generation replaces the one before."""
        new, old = self.known
        missing = [u for u in units if u not in new and u not in old]
        missing.sort(key=lambda u: _PLAIN.fullmatch(u) is None)  # plain ones together
        fresh = dict(zip(missing, self.aligned_units(missing), strict=True))
        out = []
        for unit in units:
            found = fresh[unit] if unit in fresh else new[unit] if unit in new else old[unit]
            out.append(found)
            if len(unit) <= KNOWN_CHARS:
                new[unit] = found
        if len(new) >= KNOWN:
            self.known = {}, new
        return out

    def align(self, texts: list[str]) -> list[tuple | None]:
        """Per text none, or (measures, digest, a, b, n): linked ids with the number of their links, where a pair of ids may be
        listed more than once."""
        units = [self.units(t) for t in texts]
        index = {u: i for i, u in enumerate(dict.fromkeys(chain.from_iterable(units)))}
        slots = [np.fromiter(map(index.__getitem__, mine), np.int64, len(mine)) for mine in units]
        del units
        nothing = (0, 0, 0, 0, "", b"")
        found = self.known_units(list(index))
        good = np.array([f is not None for f in found], bool)
        n_a, n_b, n_groups, n_links, written, links = zip(*[f or nothing for f in found], strict=True) if found else [()] * 6
        counts = np.array([n_a, n_b, n_groups, n_links], np.int64)
        n_links = counts[3]
        first = np.cumsum(n_links) - n_links
        linked = np.frombuffer(b"".join(links), np.int32).reshape(-1, 2)

        out = []
        for mine in slots:
            if not good[mine].all():
                out.append(None)
                continue
            digest = hashlib.sha256(";".join([written[u] for u in mine.tolist()]).encode()).hexdigest()
            once, times = np.unique(mine, return_counts=True)
            sizes = n_links[once]
            where = np.repeat(first[once] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            pairs = linked[where]
            out.append((counts[:, mine].sum(axis=1).tolist(), digest, pairs[:, 0], pairs[:, 1], np.repeat(times.astype(np.int32), sizes)))
        return out


_ready: dict[str, Aligner] = {}


def _aligner(pair: Pair) -> Aligner:
    if pair.key not in _ready:
        _ready.clear()
        _ready[pair.key] = Aligner(pair.a.value, pair.b.value, pair.by_rank)
        gc.freeze()  # or each collection would go through both vocabularies
    return _ready[pair.key]


_ALIGNED = pa.schema(
    [("key", pa.binary()), ("copies", pa.int64()), *((c, pa.int64()) for c in MEASURES), ("groups_sha256", pa.string()),
     *((c, pa.list_(pa.int32())) for c in ("a", "b", "n"))]
)
_ALIGNED_SQL = (
    "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "a array<int>, b array<int>, n array<int>"
)


def _align_texts(pair: Pair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(pair)

        def aligned(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
            done = []
            for (key, copies, _), found in zip(rows, aligner.align([text for _, _, text in rows]), strict=True):
                if found is not None:
                    measures, *rest = found
                    done.append((key, copies, *measures, *rest))
            columns = zip(*done, strict=True) if done else [[]] * len(_ALIGNED)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ALIGNED, strict=True)], schema=_ALIGNED)

        rows, held = [], 0
        for batch in batches:
            columns = (batch.column(c) for c in ("key", "copies", "body"))
            for key, copies, body in zip(*columns, strict=True):
                try:
                    text = body.as_py().decode()
                except UnicodeDecodeError:
                    continue
                rows.append((key.as_py(), copies.as_py(), text))
                held += len(text)
                if held >= BLOCK:
                    yield aligned(rows)
                    rows, held = [], 0
        if rows:
            yield aligned(rows)

    return run


def aligned_texts(docs: DataFrame, pair: Pair, text: str = "text") -> DataFrame:
    """One row per different text that both tokenizers give back: its digest, copies, measures and pairs. Copies are counted in
    each task before the shuffle."""
    texts = docs.filter(F.octet_length(text) > 0).groupBy(F.col(text).alias("body")).agg(F.count("*").alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("body", 256)).alias("key"), "copies", F.col("body").cast("binary").alias("body"))
    return keyed.mapInArrow(_align_texts(pair), _ALIGNED_SQL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): the links of the corpus by id pair, and whether no pair of this B id has more."""
    linked = aligned.select("copies", F.explode(F.arrays_zip("a", "b", "n")).alias("link"))
    counts = linked.groupBy("link.a", "link.b").agg(F.sum(F.col("link.n") * F.col("copies")).alias("count"))
    counts = stored(counts, "pair-counts")
    # At most one row per B id.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _head(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent pairs, at most ``size``: all whose count is in one of the highest classes, eight to a doubling."""
    classed = counts.withColumn("class", F.floor(F.log2("count") * 8))
    lowest, taken = None, 0
    for row in sorted(classed.groupBy("class").agg(F.count("*").alias("n")).collect(), reverse=True):
        taken += row["n"]
        if taken > size:
            break
        lowest = row["class"]
    some = F.lit(False) if lowest is None else F.col("class") >= lowest
    return classed.filter(some).drop("class")


def link_sums(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """The texts with their measures, n_best and count_sum: the links whose pair is the best of its B id, and the sum of the
    counts of all links."""
    linked = aligned.select("key", F.explode(F.arrays_zip("a", "b", "n")).alias("link")).select("key", "link.*")
    few = F.broadcast(_head(counts, head))  # of at most ``head`` rows
    found = linked.join(few, ["a", "b"])
    others = linked.join(few, ["a", "b"], "left_anti").join(counts, ["a", "b"])
    n_best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best")
    # The links of a text are summed in each task before the shuffle.
    sums = found.unionByName(others).groupBy("key").agg(n_best, F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return aligned.drop("a", "b", "n").join(sums, "key").select(*KEPT, *LINKED)


def measures(docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, the measures of its text, and the digest of its groups."""
    aligned = stored(aligned_texts(docs, pair, text), "aligned")
    texts = link_sums(aligned, pair_counts(aligned), head)

    # A text with very many copies would have all its documents in one task. Of n documents at most HOT_KEYS texts have
    # more than n / HOT_KEYS, so that their list is small; their measures are given to as many tasks as they need.
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"))
    limit = max(1, docs.count() // HOT_KEYS)
    slots = F.greatest(F.lit(1), F.ceil(F.col("copies") / limit)).cast("int")
    hot = aligned.filter(F.col("copies") > limit).select("key", slots.alias("slots"))
    dealt = docs.join(F.broadcast(hot), "key", "left").withColumn(
        "slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("slots", F.lit(1))).cast("int")
    )
    spread = texts.withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    found = dealt.join(spread, ["key", "slot"], "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in (*MEASURES, *LINKED)]
    return found.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
