"""A corpus pipeline over ``documents`` in five stages. Each works on all that the one before it kept, and is written as
Parquet and read again before the next; all but the last return the columns of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import decontaminate, line_dedup, mixing, quality, simhash
from loglens.llm.shared import own_name
from loglens.session import work_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.5 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = own_name(docs, "score")
    return quality.scored(docs, model, name=score).filter(F.col(score) >= 0.5).drop(score)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages of a twentieth of their words or more."""
    name = own_name(docs, "scan")
    scan = decontaminate.scan_column(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.withColumn(name, scan).filter(~decontaminate.is_contaminated(name)).drop(name)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", not_contaminated),
    ("mixing", mixed),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last is returned, the others are written to the shared work folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
