"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.hash("v", "u").cast("bigint"))).first())


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_iter: int = 60) -> DataFrame:
    """GRA14: ``(wallet, component)``; a component is named after its smallest wallet.

    The edge set shrinks towards stars in logarithmically many rounds. Each round
    is two aggregations and two joins against one row per node, so a hub's edges
    are never gathered in one place.
    """
    e = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    e = cut_lineage(e.distinct())
    before = _state(e)
    for _ in range(max_iter):
        e = cut_lineage(_small(_large(e)))
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_iter} rounds")
    roots = e.select(F.col("v").alias("wallet")).distinct().withColumn("component", F.col("wallet"))
    out = e.select(F.col("u").alias("wallet"), F.col("v").alias("component")).unionByName(roots)
    if nodes is None:
        return out
    return nodes.select("wallet").distinct().join(out, "wallet", "left").select("wallet", F.coalesce("component", "wallet").alias("component"))
