"""What filters remove, in every order of application, and how far they remove the same.

Each row gets a mask with one bit per filter that it fails. All filters but the last judge a text by itself; the last one
fails rows whose whole text a row with a smaller id has, which tries over prefix ranges tell (``text_tries``). The masks
of a part are reduced to counts, and everything about every order follows from these: what is left after a set of
filters is the sum over the masks that miss it.

Null texts are empty, null parts the empty string. Rows repeat as in the input; rows with a null id are no copies, make none and
have no labels; a document has a label if any of its rows in the table of labels has it. Copies with the same id are no
copies of each other. Extra columns are not used. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import as_bytes, word_runs
from loglens.llm.text_tries import RANGES, TRIE_BYTES, first_copies

NAMES = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_UPPER = 2  # per cent of the code points
_MARK = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point

Judge = Callable[[bytes], int]


def failures(text: bytes) -> int:
    """The bits of A to D: few words, few different ones, many capitals, marks of markup."""
    n, different = 0, set()
    for words in word_runs(text):
        n += len(words)
        different.update(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUATION))
    return (
        (n < MIN_WORDS)
        | (100 * len(different) < MIN_DISTINCT * n) << 1
        | (100 * upper > MAX_UPPER * points) << 2
        | bool(_MARK.search(text)) << 3
    )


def mask_column(text: str, judge: Judge = failures) -> Column:
    """The mask of each text by itself."""

    @F.arrow_udf("int")
    def mask(column: pa.Array) -> pa.Array:
        return pa.array([judge(x) for x in as_bytes(column)], pa.int32())

    return mask(F.col(text).cast("binary"))


def masks(
    docs: DataFrame, labels: DataFrame, judge: Judge = failures, names: str = NAMES,
    doc_id: str = "doc_id", text: str = "text", part: str = "source",
    trie_bytes: int = TRIE_BYTES, ranges: int = RANGES,
) -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and mask, and how many of them have the labels.

    Of rows that fail alike but for the last filter, the first copies pass it and the others do not, so that both are
    counted by joining narrow rows with the labels, and no text or flag travels back to its document.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).alias("body"),
    )
    every = rows.select("doc_id", "part", mask_column("body", judge).alias("mask"))
    firsts = first_copies(rows, judge, "doc_id", "body", "part", trie_bytes, ranges)
    nothing = F.lit(0).cast("bigint")
    counted = (
        every.filter("doc_id is not null")
        .select("doc_id", "part", "mask", F.lit(1).cast("bigint").alias("n"), nothing.alias("n_first"))
        .unionByName(firsts.select("doc_id", "part", F.col("value").alias("mask"), nothing.alias("n"), F.col("n").alias("n_first")))
    )
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    known = counted.join(marks, "doc_id", "left").select("part", "mask", "n", "n_first", "good", "toxic")
    # Rows without an id would all meet in one task of the join.
    unknown = every.filter("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    no_mark = F.lit(0)
    known = known.unionByName(
        unknown.select("part", "mask", "n", F.col("n").alias("n_first"), no_mark.alias("good"), no_mark.alias("toxic"))
    )
    kinds = {"n": F.lit(1), "good": F.coalesce("good", no_mark), "toxic": F.coalesce("toxic", no_mark)}
    sums = [F.sum(F.col("n") * k).alias(f"all_{c}") for c, k in kinds.items()]
    sums += [F.sum(F.col("n_first") * k).alias(f"first_{c}") for c, k in kinds.items()]
    totals = known.groupBy("part", "mask").agg(*sums)
    copy = 1 << (len(names) - 1)
    passing = F.struct(F.col("mask"), *[F.col(f"first_{c}").alias(c) for c in kinds])
    failing = F.struct(
        F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), *[(F.col(f"all_{c}") - F.col(f"first_{c}")).alias(c) for c in kinds]
    )
    both = totals.select("part", F.explode(F.array(passing, failing)).alias("row"))
    return both.select("part", "row.*").filter("n > 0")


def _steps(names: str) -> str:
    """Every step of every order: its filter's bit, and the set of those before."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append({"filter_order": "".join(names[i] for i in order), "step": step, "filter": f, "before": before})
            before |= 1 << f
    return json.dumps(rows)


def report(masks: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from the rows by part and mask."""
    k = len(names)
    sets = range(1 << k)
    mask = F.col("mask")

    def left(column: str) -> Column:
        """What is left after each set of filters."""
        return F.array(*[F.sum(F.when(mask.bitwiseAND(F.lit(s)) == 0, F.col(column)).otherwise(F.lit(0))) for s in sets])

    # Each order has one first of the filters that a row fails, and each of them is first in as many orders.
    share = F.expr(f"n * ({factorial(k)} div bit_count(mask))")
    shapley = [F.sum(F.when(mask.bitwiseAND(F.lit(1 << f)) != 0, share).otherwise(F.lit(0))) for f in range(k)]
    alone = [F.sum(F.when(mask == 1 << f, F.col("n")).otherwise(F.lit(0))) for f in range(k)]
    parts = masks.groupBy("part").agg(
        left("n").alias("n"), left("good").alias("good"), left("toxic").alias("toxic"),
        F.array(*shapley).alias("shapley"), F.array(*alone).alias("alone"),
    )
    steps = F.from_json(F.lit(_steps(names)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")
    rows = parts.withColumn("at", F.explode(steps)).select("*", "at.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    after = F.col("before").bitwiseOR(bit)

    def removed(column: str) -> Column:
        return F.col(column)[F.col("before")] - F.col(column)[after]

    failing = F.col("n")[F.lit(0)] - F.col("n")[bit]
    return rows.select(
        "part", "filter_order", "step",
        F.col("n")[after].alias("kept"),
        removed("n").alias("removed"),
        (failing - removed("n")).alias("redundant"),
        F.col("alone")[F.col("filter")].alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.col("shapley")[F.col("filter")].alias("shapley"),
    )
