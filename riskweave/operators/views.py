"""Analyst tables: enriched suspicious rows, wallets, clusters, timelines, flow summaries and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.explain import audit_columns, explanation_text
from ..functions.risk import laundering_stage, level_from_score, level_of_rank, level_rank
from ..functions.scalars import clip01
from ..functions.text import parse_id_list


def rule_statistics(results: DataFrame) -> dict[str, DataFrame]:
    """AGG13: frequency of top typologies with the total and the most common one, and frequency of fired ids."""
    per = results.where(F.col("heuristic_top_typology").isNotNull()).groupBy(F.col("heuristic_top_typology").alias("typology")).agg(F.count(F.lit(1)).alias("n"))
    total = results.agg(F.count(F.lit(1))).scalar()
    best = per.agg(F.min(F.struct((-F.col("n")).alias("neg"), "typology"))["typology"]).scalar()
    ids = results.select(F.explode("triggered_ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return {"typologies": per.withColumns({"total_scored": total, "most_common": best}), "ids": ids}


def enriched_suspicious(suspicious: DataFrame, tx: DataFrame, scores: DataFrame, names: Column) -> DataFrame:
    """JOI4 / VIE1: suspicious rows with transfer and score columns.

    Ids come from stored JSON text; an unreadable list falls back to the stored count. ``names`` is the
    array of rule names by id.
    """
    t = tx.select("transaction_id", "sender_wallet", "receiver_wallet", "amount", "timestamp", "asset_type", "chain_id", "fee", "label")
    s = scores.select("transaction_id", "heuristic_triggered", "heuristic_triggered_count", "heuristic_top_typology", "heuristic_top_confidence",
                      "entity_score", "graph_score", "behavioral_score", "temporal_score", "offramp_score")
    j = suspicious.join(t, "transaction_id", "left").join(s, "transaction_id", "left")
    ids = parse_id_list(F.col("heuristic_triggered"))
    n = F.size(ids)
    labels = F.transform(ids, lambda i: F.coalesce(F.try_element_at(names, i), F.format_string("Heuristic %d", i)))
    return j.withColumns(
        {
            "sender_wallet": F.coalesce("sender_wallet", F.lit("")), "receiver_wallet": F.coalesce("receiver_wallet", F.lit("")),
            "amount": F.coalesce("amount", F.lit(0.0)), "heuristic_ids": ids, "heuristic_labels": labels,
            "heuristic_triggered_count": F.when(n > 0, n).otherwise(F.coalesce("heuristic_triggered_count", F.lit(0))),
        }
    )


def with_level(clusters: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """VIE3 / TOP4: clusters with their level and its rank for ordering."""
    out = clusters.withColumn("risk_level", level_from_score(F.col("risk_score"), t))
    return out.withColumn("level_rank", level_rank(F.col("risk_level")))


def run_wallets(members: DataFrame, clusters: DataFrame, suspicious: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """VIE2: cluster wallets raised by the suspicious transfers that touch them.

    ``suspicious`` carries both wallets, score, level and typology; a self-transfer counts once per end.
    The top typology belongs to the highest score, the cluster winning ties.
    """
    c = with_level(clusters, t)
    own = members.join(c, "cluster_id").groupBy("wallet").agg(
        F.countDistinct("cluster_id").alias("cluster_count"), F.max("risk_score").alias("c_score"),
        F.max("level_rank").alias("c_rank"), F.max_by("typology", "risk_score").alias("c_type"),
    )
    ends = suspicious.select("meta_score", "risk_level", "typology", "ord", F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet"))
    sus = ends.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("suspicious_tx_count"), F.max("meta_score").alias("s_score"),
        F.max(F.greatest(level_rank(F.col("risk_level")), level_rank(level_from_score(F.col("meta_score"), t)))).alias("s_rank"),
        F.max_by("typology", F.struct("meta_score", -F.col("ord"))).alias("s_type"),
    )
    j = own.join(sus, "wallet", "left")
    raised = F.coalesce(F.col("s_score") > F.col("c_score"), F.lit(False))
    return j.select(
        "wallet", "cluster_count", F.coalesce("suspicious_tx_count", F.lit(0)).alias("suspicious_tx_count"),
        F.greatest("c_score", F.coalesce("s_score", F.lit(0.0))).alias("risk_score"),
        level_of_rank(F.greatest("c_rank", F.coalesce("s_rank", F.lit(0)))).alias("risk_level"),
        F.when(raised, F.col("s_type")).otherwise(F.col("c_type")).alias("top_heuristic"),
    )


def wallet_timeline(enriched: DataFrame) -> DataFrame:
    """VIE4: suspicious transfers per touched wallet in time order, one row each."""
    return enriched.select(F.explode(F.array_distinct(F.array("sender_wallet", "receiver_wallet"))).alias("wallet"), "timestamp", "transaction_id", "meta_score", "heuristic_labels")


def badge_labels(enriched: DataFrame, key: str) -> DataFrame:
    """SET5: distinct rule labels per wallet or cluster; distinct before collecting, and at most one entry per rule."""
    one = enriched.select(key, F.explode("heuristic_labels").alias("label")).where(F.col(key).isNotNull()).distinct()
    return one.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def flow_clusters(clusters: DataFrame, suspicious: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """VIE5: cluster risk is the mean suspicious score, else the stored risk; its level the highest of all levels."""
    s = suspicious.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.avg("meta_score").alias("m"), F.max(level_rank(F.col("risk_level"))).alias("r"), F.count(F.lit(1)).alias("n_suspicious")
    )
    j = with_level(clusters, t).join(s, "cluster_id", "left")
    risk = clip01(F.coalesce("m", "risk_score", F.lit(0.0)))
    level = level_of_rank(F.greatest("level_rank", F.coalesce("r", F.lit(0)), level_rank(level_from_score(risk, t))))
    return j.select("cluster_id", "typology", risk.alias("risk"), level.alias("risk_level"), F.coalesce("n_suspicious", F.lit(0)).alias("n_suspicious"))


def flow_nodes(roles: DataFrame, notes: DataFrame, suspicious: DataFrame, clusters: DataFrame) -> DataFrame:
    """VIE5: node risk from the graph note, else the wallet's best suspicious score, else the cluster's risk."""
    best = suspicious.select("meta_score", F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet")).groupBy("wallet").agg(F.max("meta_score").alias("w"))
    j = roles.join(notes.select("wallet", F.col("meta_score").alias("g")), "wallet", "left").join(best, "wallet", "left").join(clusters.select("cluster_id", "risk"), "cluster_id")
    badge = F.when(F.col("role") == "source", "Entry").when(F.col("role") == "exit", "Exit").otherwise("Hop")
    return j.select("cluster_id", "wallet", "role", badge.alias("badge"), clip01(F.coalesce("g", "w", "risk")).alias("risk"))


def first_per_cluster(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """VIE5: the first ``n`` rows per cluster; the row-number bound is applied before the shuffle as well."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("cluster_id").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def explanations(scores: DataFrame, tier: Column | None = None) -> DataFrame:
    """VIE6 / SCA15: explanation row per transfer with audit columns."""
    tier = F.lit("tier0") if tier is None else tier
    out = scores.withColumns(audit_columns())
    return out.select(
        "transaction_id", F.col("heuristic_top_typology").alias("pattern_type"),
        laundering_stage(F.col("offramp_score"), F.col("graph_score"), F.col("behavioral_score")).alias("laundering_stage"),
        explanation_text(tier).alias("summary"), F.col("meta_score").alias("confidence"), tier.alias("coverage_tier"),
        F.array_join(F.col("triggered_ids"), ",").alias("fired"), "top_typology_mapped", "taxonomy_mapping_failed", "n_active_lenses", "meta_score_rounded",
    )


def case_explanations(cases: DataFrame) -> DataFrame:
    """VIE7."""
    return cases.select(
        "case_id", F.col("typology").alias("pattern_type"), F.lit(None).cast("string").alias("laundering_stage"),
        F.coalesce("explanation", F.lit("No explanation available.")).alias("summary"), F.col("risk_score").alias("confidence"), F.lit("tier0").alias("coverage_tier"),
    )


def risk_queue(df: DataFrame) -> DataFrame:
    """TOP5: rows with the rank of their level and whether they are critical."""
    return df.withColumns({"rank": level_rank(F.col("risk_level")), "critical": F.col("risk_level") == "high"})


