"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the allowed distance, and fingerprints that share a variant
meet after a shuffle on variants. Two fingerprints within the distance always share one, the point half-way between them;
two that share one are never farther apart. So the fingerprints that meet at a variant are all linked to one another, and
linking each to the least of them keeps the components; there are no more of them than variants of one fingerprint, and
no pairs are formed. Equal fingerprints are one row before anything is emitted, so copies cost nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.components import components
from loglens.llm.shared import as_bytes, own_name, row_keys, stored, word_runs

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_BLOCK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if set in more than half of the hashes of its shingles."""
    counts, n, short = np.zeros(64, np.int64), 0, []
    for words in word_runs(text.lower(), shingle_words - 1):
        if len(words) < shingle_words:
            short = words
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(words) - shingle_words + 1)
        for at in range(0, len(hashes), _BLOCK):
            bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(short), seed) if short else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """Fingerprints as bigint. Null and empty texts have fingerprint zero."""

    @F.arrow_udf("bigint")
    def bits(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t, shingle_words, seed) for t in as_bytes(texts)], np.uint64)
        return pa.array(values.view(np.int64))

    return bits(F.col(text).cast("binary"))


def ball(radius: int) -> list[int]:
    """The signed 64-bit masks of at most ``radius`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the single bigint column of ``prints``, that have the components of
    all pairs within ``max_bits`` bits. ``max_bits`` is even, else half of it is no distance."""
    if max_bits < 0 or max_bits % 2:
        raise ValueError("the largest distance must be an even number of bits")
    (name,) = prints.columns
    masks = F.array(*[F.lit(m) for m in ball(max_bits // 2)])
    variants = prints.select(F.col(name).alias("a"), F.explode(masks).alias("mask")).select(
        "a", F.col("a").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = variants.withColumn("b", F.min("a").over(Window.partitionBy("variant")))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return met.filter((F.col("a") != F.col("b")) & close).select("a", "b").distinct()


def grouped(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(print, root) for each distinct value of ``print`` that has a link; ``marked`` holds a column ``print``."""
    return components(links(marked.select("print").distinct(), max_bits)).select(F.col("node").alias("print"), "root")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) per row: the least id that a row reaches over links.

    A null or empty text has fingerprint zero, linked like any other. Rows with a null id link documents and get
    their component's least id, null if it has none. Repeated rows are all returned. An empty table gives no rows;
    other columns are not read.
    """
    marked = stored(docs.select(F.col(doc_id).alias("id"), fingerprint_column(text, shingle_words).alias("print")), "prints")
    prints = marked.groupBy("print").agg(F.min("id").alias("first"))
    roots = prints.join(grouped(marked, max_bits), "print", "left").withColumn("root", F.coalesce("root", "print"))
    roots = stored(roots, "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = roots.join(least, "root").select("print", "component_id")
    return marked.join(of_print, "print").select(
        F.col("id").alias(doc_id),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with the least id, of equal ids one by hash.

    Rows with a null id come after all others, so one stays only where a component has no id. Of rows equal in id
    and text one stays. All columns are returned as they are; an empty table gives no rows.
    """
    one, two = row_keys(doc_id, text)
    marked = stored(
        docs.select(
            F.col(doc_id).alias("id"), one.alias("one"), two.alias("two"),
            fingerprint_column(text, shingle_words).alias("print"),
        ),
        "prints",
    )
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "one", "two")
    first = marked.groupBy("print").agg(F.min(rank).alias("best"))
    chosen = (
        first.join(grouped(marked, max_bits), "print", "left")
        .groupBy(F.coalesce("root", "print"))
        .agg(F.min("best").alias("best"))
    )
    names = own_name(docs, "one"), own_name(docs, "two")
    kept = chosen.select(F.col("best.one").alias(names[0]), F.col("best.two").alias(names[1]))
    return (
        docs.withColumns(dict(zip(names, (one, two), strict=True)))
        .join(kept, list(names), "left_semi")
        .dropDuplicates(list(names))
        .drop(*names)
    )
