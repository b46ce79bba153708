"""Sets per key as one value: a view for keys that are known to be small.

The long form (key, item) is the result of every operator. The nested form cuts every key into the same number of
pieces, which the caller names, whatever the sizes of the keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(pairs: DataFrame, keys: list[str], items: list[str], item: Column, name: str, pieces: int = 1) -> DataFrame:
    """(keys…, piece, sorted array). ``pairs`` holds distinct rows of keys and items; rows with a null in a key are left
    out. Each item is in the piece that a hash of it names; a piece without items has no row."""
    for key in keys:
        pairs = pairs.filter(F.col(key).isNotNull())
    piece = F.pmod(F.xxhash64(*items), F.lit(pieces)).cast("int")
    return pairs.groupBy(*keys, piece.alias("piece")).agg(F.sort_array(F.collect_list(item)).alias(name))
