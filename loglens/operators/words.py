"""Words of text records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions.text import drop_trailing_empty, word_pieces


def tokens(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word of the whole text. Rows without text are left out."""
    pieces = rows.filter(F.col(text).isNotNull()).select(*keep, word_pieces(F.col(text)).alias("_pieces"))
    return pieces.select(*keep, F.explode(drop_trailing_empty(F.col("_pieces"))).alias("word"))


def word_count(words: DataFrame, *by: str) -> DataFrame:
    """Works on tables and streams; frequent words are summed in each task before the shuffle."""
    return words.groupBy(*by, "word").agg(F.count("*").alias("n"))


def null_kinds(rows: DataFrame, value: str) -> DataFrame:
    """Counts real nulls apart from the text ``null``."""
    is_text = F.coalesce(F.col(value) == "null", F.lit(False))
    return (
        rows.select(F.col(value).isNull().alias("is_null"), is_text.alias("is_null_text"))
        .groupBy("is_null", "is_null_text")
        .agg(F.count("*").alias("n"))
    )
