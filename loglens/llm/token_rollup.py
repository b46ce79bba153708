"""Token counts as delta-maintained rollups.

A batch is a table of signed changes: documents inserted, deleted, or counted anew. It is summed by source, language
and tokenizer version and written as one delta; totals are the sum of all committed deltas. A delta becomes part of the
table by a record, a file that is named by its batch and names its folder. The file is written aside and renamed, which fails
where there is one of the batch already: the first commit of a batch stands, whatever a later one of the same name holds.
So a batch counts once, whole or not at all. ``compact`` folds committed deltas into one, by a commit like any other that
replaces them; what it replaces and what it sums are of one listing, so batches committed meanwhile count beside it.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loglens.llm.shared import WORD, as_bytes

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "source string, lang string, tokenizer string, docs bigint, tokens bigint, batch string"
_COMMITS = "batch string, folder string, replaces array<string>"


def words_counter(text: str) -> Column:
    """Runs of anything but white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def pieces_counter(text: str) -> Column:
    """Runs of ASCII letters, digits or other characters above ASCII, and single marks."""
    pieces = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^\x00-\x20\x7F0-9A-Za-z\x{80}-\x{10FFFF}]"
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pieces)), F.lit(0)).cast("bigint")


def bpe_counter(text: str, vocabulary: str) -> Column:
    """Tokens of a byte-level vocabulary in rank form, read on the workers from the path ``vocabulary``."""
    ready: dict[str, object] = {}

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        import base64

        import tiktoken

        if not ready:
            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            ready["bpe"] = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = ready["bpe"].encode_ordinary
        return pa.array([len(encode(t.decode())) for t in as_bytes(texts)], pa.int64())

    return count(F.col(text).cast("binary"))


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add documents, from (source, lang, tokenizer, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), F.col("tokens").cast("bigint").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take documents away, from the counts that they had."""
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("docs"), (-F.col("tokens")).cast("bigint").alias("tokens"))


def revised(counts: DataFrame, old: str = "old_tokens", new: str = "tokens") -> DataFrame:
    """Changes of counts of documents that stay where they are."""
    return counts.select(*KEYS, F.lit(0).cast("bigint").alias("docs"), (F.col(new) - F.col(old)).cast("bigint").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer in a folder that all executors share.

    Null sources, languages and tokenizers are groups of their own; null counts add nothing. A batch without rows commits
    like any other. A new folder has no totals. Extra columns of the changes are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._at(self.path).toUri() if "://" in self.path else jvm.java.io.File(self.path).toURI(), spark._jsc.hadoopConfiguration()
        )
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for name in ("commits", "aside", "deltas"):
            self._files.mkdir(self._at(f"{self.path}/{name}"), None, True)

    def commit(self, batch: str, changes: DataFrame, replaces: list[str] | None = None) -> bool:
        """Adds a batch, and tells whether it did: the first commit of a batch stands, and others change nothing."""
        folder = uuid.uuid4().hex
        summed = changes.groupBy(*KEYS).agg(
            F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
        )
        summed.withColumn("batch", F.lit(batch)).write.parquet(f"{self.path}/deltas/folder={folder}")
        aside = f"{self.path}/aside/{folder}"
        record = self.spark.createDataFrame([(batch, folder, replaces or [])], _COMMITS)
        record.coalesce(1).write.json(aside)
        (part,) = [p for p in self._names(aside) if p.startswith("part-")]
        name = f"{hashlib.sha256(batch.encode()).hexdigest()}.json"
        try:
            self._files.rename(self._at(f"{aside}/{part}"), self._at(f"{self.path}/commits/{name}"), self._rename)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._files.util().listStatus(self._at(folder))]

    def _commits(self) -> list[Row]:
        """The records of batches that no other replaces."""
        records = self.spark.read.schema(_COMMITS).json(f"{self.path}/commits").collect()
        gone = {b for r in records for b in r.replaces}
        return [r for r in records if r.batch not in gone]

    def deltas(self, commits: list[Row] | None = None) -> DataFrame:
        """The rows of all deltas that count, with their batch. Folders are named by the commits, one for each batch."""
        folders = [f"{self.path}/deltas/folder={r.folder}" for r in (self._commits() if commits is None else commits)]
        if not folders:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*sorted(folders))

    def totals(self, commits: list[Row] | None = None) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens); groups without documents and tokens left are gone."""
        summed = self.deltas(commits).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds the deltas that count into one. A batch folded in counts no more if it is run again, as its record stays.
        Compactions run one at a time; one that fails before its record is there changes nothing."""
        commits = self._commits()
        self.commit(f"compaction {uuid.uuid4().hex}", self.totals(commits), sorted(r.batch for r in commits))
