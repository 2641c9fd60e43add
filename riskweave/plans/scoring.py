"""The scoring run: transfers to features, rules, lens scores, meta score, suspicious set and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, LENS_SCORES, Settings
from ..operators import clusters as cl
from ..operators import graph as g
from ..operators.betweenness import betweenness
from ..operators.communities import leiden, louvain
from ..operators.components import connected_components
from ..operators.cycles import clustering, ego_cycles
from ..operators.fusion import meta_stack, score_rows
from ..operators.pagerank import pagerank
from ..operators.rules.engine import evaluate, peel_edges, rule_aggregates, wallet_context
from ..operators.rules.enrich import tag_flags
from ..operators.rules.registry import RuleBook
from ..operators.selection import suspicious, touched_wallets
from ..operators.tx_features import transaction_features
from ..operators.typology import cluster_typology
from ..operators.window24 import WINDOW_METRICS, window_features
from ..session import cut_lineage

GLOBAL_METRICS = ["pagerank", "betweenness", "clustering_coefficient"]

# Sender graph columns the lenses read without a prefix.
SENDER_COPIES = [
    "balance_ratio", "unique_counterparties", "relay_pattern_score", "fan_in_ratio", "weighted_in", "in_degree",
    "suspicious_neighbor_ratio_1hop", "suspicious_neighbor_ratio_2hop",
]


@dataclass
class Graph:
    """Edges, nodes and local metrics of one transfer table, materialised once."""

    edges: DataFrame
    nodes: DataFrame
    metrics: DataFrame
    neighbours: DataFrame


def build_graph(tx: DataFrame) -> Graph:
    edges = cut_lineage(g.wallet_edges(tx))
    metrics = cut_lineage(g.node_metrics(edges))
    return Graph(edges, metrics.select("wallet"), metrics, g.neighbours(edges))


def global_metrics(graph: Graph, mode: str = "linear") -> DataFrame:
    """GRA4: PageRank, betweenness and clustering per node, as the caller asks; no size of the graph decides.

    ``linear``: PageRank and clustering, with betweenness 0. ``full``: all three; betweenness
    costs nodes times edges. ``none``: zeros.
    """
    if mode not in ("linear", "full", "none"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "none":
        return graph.nodes.select("wallet", *[F.lit(0.0).alias(c) for c in GLOBAL_METRICS])
    pr = pagerank(graph.edges, graph.nodes)
    bt = betweenness(graph.edges, graph.nodes) if mode == "full" else graph.nodes.select("wallet", F.lit(0.0).alias("betweenness"))
    return pr.join(bt, "wallet").join(clustering(graph.edges, graph.nodes), "wallet")


def node_features(graph: Graph, mode: str = "linear", settings: Settings = DEFAULTS) -> DataFrame:
    """AGG4, AGG8-AGG11 and the global metrics in one wallet table."""
    glob = global_metrics(graph, mode)
    risky = g.risky_nodes(glob, settings.risky_pagerank)
    shares = g.risky_neighbour_shares(graph.neighbours, risky)
    return g.structural_features(graph.metrics, graph.neighbours).join(glob, "wallet", "left").join(shares, "wallet", "left").na.fill(0)


def combined_features(txf: DataFrame, nodes: DataFrame, window: DataFrame) -> DataFrame:
    """JOI1 + JOI2: node and window features on both ends, missing numbers as 0, eight sender columns copied."""

    def pre(df: DataFrame, cols: list[str], key: str, prefix: str) -> DataFrame:
        return df.select(F.col("wallet").alias(key), *[F.col(c).alias(prefix + c) for c in cols])

    cols = [c for c in nodes.columns if c != "wallet"]
    out = txf
    for side in ("sender", "receiver"):
        key = f"{side}_wallet"
        out = out.join(pre(nodes, cols, key, f"{side}_graph_"), key, "left").join(pre(window, WINDOW_METRICS, key, f"{side}_sub_"), key, "left")
    numeric = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
    out = out.na.fill(0, numeric)
    return out.withColumns({c: F.col(f"sender_graph_{c}") for c in SENDER_COPIES})


def wallet_rules(
    tx: DataFrame, graph: Graph, shares: DataFrame, as_of: Column | None = None, enrichment: DataFrame | None = None,
    book: RuleBook | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Rule results per wallet."""
    profiles = g.wallet_profiles(tx, graph.metrics)
    structure = g.structural_features(graph.metrics, graph.neighbours)
    ctx = wallet_context(
        profiles, structure.select("wallet", "relay_pattern_score", "unique_counterparties"), shares,
        ego_cycles(graph.edges), peel_edges(graph.edges, settings.hot_rows), as_of=as_of, enrichment=enrichment,
    )
    return evaluate(ctx, book)


# rule results that stay at wallet level unless asked for
WALLET_LEVEL = ["heuristic_vector", "applicability_vector", "heuristic_explanations", "top_rules"]


def with_rule_aggregates(rules: DataFrame) -> DataFrame:
    """RUL-A per wallet, before the join to transfers."""
    agg = rule_aggregates(F.col("heuristic_vector"), F.col("heuristic_top_confidence"))
    return rules.withColumns({c: agg[c] for c in ("heuristic_mean", "heuristic_max", "heuristic_triggered_ratio")})


def score_transfers(
    tx: DataFrame, rules: DataFrame, lens: DataFrame | None = None, entity: DataFrame | None = None,
    settings: Settings = DEFAULTS, has_tags: bool = False, has_links: bool = False, n_lenses: int = 0, vectors: bool = False,
    learned: str | None = None,
) -> DataFrame:
    """Score rows per transfer: sender rules, lens scores (0 where no model is given), fusion and tier.

    ``lens`` holds scores by transaction_id, ``entity`` holds entity_score by wallet; ``learned`` names a column of ``lens`` that
    stands for the weighted score. The 185-slot vectors stay
    in the wallet-level rule table, since copying them to every transfer would multiply the output; only their
    aggregates are joined. ``vectors=True`` attaches them.
    """
    per = with_rule_aggregates(rules).withColumnRenamed("wallet", "sender_wallet")
    if not vectors:
        per = per.drop(*WALLET_LEVEL)
    rows = tx.join(per, "sender_wallet", "left")
    if entity is not None:
        rows = rows.join(entity.select(F.col("wallet").alias("sender_wallet"), "entity_score"), "sender_wallet", "left")
    if lens is not None:
        rows = rows.join(lens, "transaction_id", "left")
    missing = {c: F.lit(0.0) for c in LENS_SCORES if c not in rows.columns}
    present = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in LENS_SCORES if c in rows.columns}
    stack = meta_stack(rows.withColumns({**missing, **present}), has_tags, has_links, n_lenses)
    if learned is None:
        return score_rows(stack, settings)
    return score_rows(stack, settings, F.col(learned)).drop(learned)


def entity_fallback(graph: Graph, partition: DataFrame) -> DataFrame:
    """Entity scores without a classifier."""
    return cl.entity_scores(cl.community_features(graph.edges, graph.metrics, partition), partition)


@dataclass
class Run:
    """Result tables of one scoring run."""

    scores: DataFrame
    suspicious: DataFrame
    members: DataFrame
    clusters: DataFrame
    graph: Graph
    components: DataFrame


def cluster_tables(scored: DataFrame, flagged: DataFrame, graph: Graph, settings: Settings = DEFAULTS) -> Run:
    """Suspicious wallets to clusters with facts and typology; suspicious rows get their cluster."""
    comps = cut_lineage(connected_components(graph.edges, graph.nodes))
    members = cut_lineage(cl.cluster_members(comps, touched_wallets(flagged)))
    facts = cl.cluster_facts(graph.edges, scored, members, comps)
    inner = cut_lineage(cl.cluster_edges(graph.edges, members))
    degrees = cut_lineage(cl.member_degrees(graph.edges, members))
    typ = cluster_typology(inner, degrees, cl.cluster_transfers(scored, members), settings.hot_rows)
    table = facts.join(typ.select("cluster_id", "typology"), "cluster_id", "left")
    return Run(scored, cl.assign_clusters(flagged, members), members, table, graph, comps)


def run_pipeline(
    tx: DataFrame, settings: Settings = DEFAULTS, as_of: Column | None = None, mode: str = "linear",
    communities: str = "louvain", enrichment: DataFrame | None = None, book: RuleBook | None = None,
    tags: DataFrame | None = None, links: DataFrame | None = None, models=None,
) -> Run:
    """The whole run over cleaned transfers.

    ``tags`` (wallet_address, tag, valid_from, valid_to) feed the tag rules, ``links`` are records about owners; the coverage tier follows from
    which of the two have rows. ``models`` (see ``model_store``) add lens scores, the learned meta score and its thresholds; without them the
    weighted score is used. ``enrichment`` has further rule inputs by wallet.
    """
    if communities not in ("louvain", "leiden", "components"):
        raise ValueError(f"unknown communities {communities}")
    has_tags = tags is not None and not tags.isEmpty()
    has_links = links is not None and not links.isEmpty()
    if has_tags:
        flags = tag_flags(tx, tags)
        enrichment = flags if enrichment is None else enrichment.join(flags, "wallet", "full_outer")
    if models is not None:
        from .training import learned_run

        return learned_run(tx, models, settings, as_of, mode, enrichment, book, has_tags, has_links)
    graph = build_graph(tx)
    glob = global_metrics(graph, mode)
    shares = g.risky_direct_share(graph.neighbours, g.risky_nodes(glob, settings.risky_pagerank))
    rules = wallet_rules(tx, graph, shares, as_of, enrichment, book, settings)
    part = partition(graph, communities)
    scored = cut_lineage(score_transfers(tx, rules, None, entity_fallback(graph, part), settings, has_tags, has_links))
    return cluster_tables(scored, scored.where(suspicious(settings)), graph, settings)


def partition(graph: Graph, communities: str) -> DataFrame:
    """(wallet, community) by the named method."""
    if communities == "components":
        return connected_components(graph.edges, graph.nodes).withColumnRenamed("component", "community")
    return (louvain if communities == "louvain" else leiden)(graph.edges, graph.nodes)


def feature_tables(tx: DataFrame, settings: Settings = DEFAULTS, mode: str = "linear") -> dict[str, DataFrame]:
    """The four feature tables: transaction, graph, window and combined."""
    graph = build_graph(tx)
    txf = transaction_features(tx, settings)
    nodes = node_features(graph, mode, settings)
    window = window_features(tx, settings)
    return {"transaction": txf, "graph": nodes, "window": window, "combined": combined_features(txf, nodes, window)}
