"""Score fusion: meta stack, fallback score, tiers, result rows, threshold choice and cohort policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, FUSION_WEIGHTS, LENS_SCORES, Settings, Thresholds
from ..functions.risk import coverage_tier, level_from_score
from ..functions.scalars import clip01
from .ordered import ordered_scan

# Column order of the meta feature table.
META_COLUMNS = [
    *LENS_SCORES, "heuristic_mean", "heuristic_max", "heuristic_triggered_count", "heuristic_top_confidence",
    "heuristic_triggered_ratio", "has_entity_intel", "has_address_tags", "coverage_tier_0", "coverage_tier_1",
    "coverage_tier_2", "n_lenses_available",
]


def fixed_columns(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """FIL7: named feature columns in a fixed order; absent, null and non-numeric values become 0."""
    have = set(df.columns)
    cols = [
        (F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names
    ]
    return df.select(*(keep or []), *cols)


def weighted_score(columns: dict[str, Column] | None = None) -> Column:
    """MET2: weighted sum of lens scores and the strongest rule, clipped to [0, 1]."""
    columns = columns or {}
    terms = [F.coalesce(columns.get(k, F.col(k)), F.lit(0.0)) * w for k, w in FUSION_WEIGHTS.items()]
    return clip01(reduce(lambda a, b: a + b, terms))


def meta_stack(rows: DataFrame, has_tags: bool = False, has_links: bool = False, n_lenses: int = 0) -> DataFrame:
    """MET1: the seventeen meta columns: lens scores and rule aggregates of ``rows`` plus coverage."""
    tier = coverage_tier(F.lit(True), F.lit(has_tags), F.lit(has_links))
    rules = ["heuristic_mean", "heuristic_max", "heuristic_triggered_ratio", "heuristic_triggered_count"]
    out = rows.na.fill(0, rules).withColumns(
        {
            "has_entity_intel": F.lit(float(has_links)),
            "has_address_tags": F.lit(float(has_tags)),
            "coverage_tier": tier,
            "n_lenses_available": F.lit(float(n_lenses)),
        }
    )
    return out.withColumns({f"coverage_tier_{i}": (F.col("coverage_tier") == f"tier{i}").cast("double") for i in range(3)})


def score_rows(stack: DataFrame, settings: Settings = DEFAULTS, learned: Column | None = None) -> DataFrame:
    """MET5, MET6, SCA6: meta score, tier, provenance and decision threshold."""
    t = settings.thresholds
    meta = weighted_score() if learned is None else learned
    out = stack.withColumn("meta_score", meta)
    return out.withColumns(
        {
            "risk_level": level_from_score(F.col("meta_score"), t),
            "meta_provenance": F.lit("fallback" if learned is None else "learned"),
            "decision_threshold": F.lit(t.decision),
        }
    )


def precision_recall_points(df: DataFrame, label: str, score: str, hot_rows: int | None = None) -> DataFrame:
    """EVA4 / WIN11: one point per distinct score, from cumulative counts in descending score order."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("cnt")
    )
    run = ordered_scan(by, [], ["-threshold"], running={"tp": "pos", "predicted": "cnt"}, hot_rows=hot_rows)
    total = df.agg(F.sum(F.col(label).cast("bigint"))).scalar()
    return run.select(
        "threshold", "tp", "predicted", "pos", "cnt",
        (F.col("tp") / F.col("predicted")).alias("precision"),
        F.when(total > 0, F.col("tp") / total).otherwise(0.0).alias("recall"),
    )


def choose_threshold(points: DataFrame, min_recall: float = 0.95) -> DataFrame:
    """MET4: highest precision among points that keep the recall; equal precision takes the lowest threshold.

    The lowest threshold always keeps full recall, so a choice exists whenever there are points.
    """
    pick = points.where(F.col("recall") >= min_recall).agg(
        F.max_by(F.struct("threshold", "precision", "recall"), F.struct("precision", -F.col("threshold"))).alias("b")
    )
    t, p, r = F.col("b.threshold"), F.col("b.precision"), F.col("b.recall")
    return pick.select(
        t.alias("decision_threshold"), p.alias("precision_at_threshold"), r.alias("recall_at_threshold"),
        (2 * p * r / (p + r + 1e-8)).alias("f1_at_threshold"),
        F.least(t * 1.5, F.lit(0.95)).alias("high_risk_threshold"),
        F.greatest(t * 0.5, F.lit(0.1)).alias("low_risk_ceiling"),
    )


def thresholds_from(row) -> Thresholds:
    """A ``choose_threshold`` row as settings."""
    return Thresholds(row["decision_threshold"], row["high_risk_threshold"], row["low_risk_ceiling"])


def apply_policies(scores: DataFrame, policies: DataFrame, cohort: str) -> DataFrame:
    """MET7: the action per row under its cohort's alert and case thresholds."""
    j = scores.join(policies, scores[cohort] == policies["cohort_key"], "left")
    action = (
        F.when(F.col("meta_score") >= F.col("case_threshold"), "case")
        .when(F.col("meta_score") >= F.col("alert_threshold"), "alert")
        .otherwise("none")
    )
    return j.withColumn("action", action)
