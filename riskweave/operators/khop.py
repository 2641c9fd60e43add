"""Neighbourhood expansion around one or many wallets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import induced, neighbours, nodes_of
from .ordered import ordered_scan


def k_hop_nodes(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Wallets within ``hops`` undirected steps of the seeds, with their distance; unknown seeds vanish."""
    known = nodes_of(edges).join(seeds.select("wallet"), "wallet", "left_semi")
    seen = known.withColumn("hop", F.lit(0))
    nb = neighbours(edges)
    for h in range(1, hops + 1):
        rim = seen.where(F.col("hop") == h - 1)
        grown = rim.join(nb, "wallet").select(F.col("nb").alias("wallet")).distinct()
        seen = seen.unionByName(grown.join(seen, "wallet", "left_anti").withColumn("hop", F.lit(h)))
        if h > 2:
            seen = cut_lineage(seen)
    return seen


def k_hop_subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> dict[str, DataFrame]:
    """GRA11 + GRA12: nodes and induced edges around the seeds."""
    nodes = k_hop_nodes(edges, seeds, hops)
    return {"nodes": nodes, "edges": induced(edges, nodes)}


def stratified_seeds(labels: DataFrame, per_label: int, seed: int = 42, hot_rows: int | None = None) -> DataFrame:
    """Up to ``per_label`` wallets per label in a seeded hash order."""
    mixed = labels.withColumn("_h", F.xxhash64("wallet", F.lit(seed)))
    return ordered_scan(mixed, ["label"], ["_h", "wallet"], index="_i", hot_rows=hot_rows).where(F.col("_i") <= per_label).select("wallet", "label")


def bounded_sample(
    edges: DataFrame, labels: DataFrame, max_nodes: int, hops: int, per_label: int, seed: int = 42, hot_rows: int | None = None
) -> DataFrame:
    """GRA13: seeds stratified by label, grown by hops, nearest first, then filled in hash order up to ``max_nodes``."""
    seeds = stratified_seeds(labels, per_label, seed, hot_rows)
    near = k_hop_nodes(edges, seeds, hops)
    every = nodes_of(edges).join(near, "wallet", "left").withColumn("hop", F.coalesce("hop", F.lit(hops + 1)))
    mixed = every.withColumn("_h", F.xxhash64("wallet", F.lit(seed)))
    return ordered_scan(mixed, [], ["hop", "_h", "wallet"], index="_i", hot_rows=hot_rows).where(F.col("_i") <= max_nodes).select("wallet", "hop")
