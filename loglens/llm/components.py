"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.shared import stored

MAX_ROUNDS = 60  # the rounds needed grow with the logarithm of the longest path


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the least ``b`` of each ``a``. The minimum is taken within tasks first, and the join back can
    be split where one node has very many edges."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbours and itself."""
    return (
        _with_least(_both_ways(edges))
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them. Edges go from larger to smaller nodes."""
    near = _with_least(edges)
    return (
        near.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(near.select("a", F.col("least").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (two bigint columns a, b): the root is the least node that it reaches.

    Every round is written to the shared work folder. An edge from a node to itself and repeated edges change nothing;
    a node with no other edge is not returned; no edges give no rows. Edges with a null end are ignored.
    """
    a, b = (F.col(c) for c in edges.columns)
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), a.isNull().alias("x"), b.isNull().alias("y"))
    now = stored(now.filter("a <> b and not x and not y").select("a", "b").distinct(), "edges")
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        now = stored(_small_star(_large_star(now).distinct()), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
