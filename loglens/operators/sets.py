"""Distinct values per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.operators.nested import nest


def whole_pairs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the rows that have both."""
    return rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)


def key_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value); rows without a key or value are left out."""
    return whole_pairs(rows, key, value).distinct()


def value_sets(pairs: DataFrame, key: str, value: str, name: str = "values", pieces: int = 1) -> DataFrame:
    """(key, piece, sorted values): a view of the pairs."""
    return nest(pairs, [key], [value], F.col(value), name, pieces)
