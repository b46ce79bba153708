"""A fence for the optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps filters on ``columns`` above the expressions that make them.

    Spark pushes a filter on a computed column below the projection by repeating the expression in the filter. For
    long decoding expressions this doubles the work and grows the generated code past what the JVM compiles. A
    generator that gives one row per row stops that; it costs a row copy.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.stack(F.lit(1), *[F.col(c) for c in columns]).alias(*columns)).select(*df.columns)
