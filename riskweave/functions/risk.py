"""Risk levels, coverage tiers, label checks and stages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Thresholds

# Severity order and label words.
LEVELS = ["low", "medium-low", "medium", "high"]
BAD_LABELS = ["illicit", "fraud", "suspicious", "malicious", "scam", "true", "1", "yes"]
BAD_FRAGMENTS = ["illicit", "fraud", "suspic"]
RISKY_TAGS = ["mixer", "darknet", "ransomware", "sanctioned", "scam", "gambling"]


def level_from_score(score: Column, t: Thresholds = Thresholds()) -> Column:
    """SCA6: score to level; a missing score is low."""
    s = score.try_cast("double")
    return (
        F.when(s.isNull() | F.isnan(s), "low").when(s >= t.high, "high").when(s >= t.decision, "medium")
        .when(s <= t.low, "low").otherwise("medium-low")
    )


def normalise_level(level: Column) -> Column:
    """SCA7: trimmed lower-case level; anything unknown is low."""
    v = F.lower(F.trim(level))
    return F.when(v.isin(LEVELS), v).otherwise("low")


def level_rank(level: Column) -> Column:
    """SCA7: 0 for low up to 3 for high."""
    return (F.array_position(F.array(*map(F.lit, LEVELS)), normalise_level(level)) - 1).cast("int")


def level_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int") + 1)


def max_level(*levels: Column) -> Column:
    """SCA7: the most severe of several levels."""
    ranks = [level_rank(x) for x in levels]
    return level_of_rank(ranks[0] if len(ranks) == 1 else F.greatest(*ranks))


def label_is_suspicious(label: Column) -> Column:
    """SCA8: the source label itself marks the row."""
    v = F.lower(F.trim(label.cast("string")))
    hit = v.isin(BAD_LABELS)
    for word in BAD_FRAGMENTS:
        hit = hit | v.contains(word)
    return F.coalesce(hit, F.lit(False))


def coverage_tier(has_transactions: Column, has_tags: Column, has_links: Column) -> Column:
    """SCA13: links outrank tags, tags outrank plain transfers."""
    return F.when(has_links, "tier2").when(has_tags, "tier1").otherwise("tier0")


def laundering_stage(offramp: Column, graph: Column, behavioral: Column) -> Column:
    """SCA14: the first lens above one half names the stage."""
    zero = F.lit(0.0)
    return (
        F.when(F.coalesce(offramp, zero) > 0.5, "integration")
        .when(F.coalesce(graph, zero) > 0.5, "layering")
        .when(F.coalesce(behavioral, zero) > 0.5, "placement")
    )


def applicability_counts(vector: Column) -> dict[str, Column]:
    """AGG15: number of slots per applicability status."""

    def n(status: str) -> Column:
        return F.size(F.filter(vector, lambda x: x == status))

    return {
        "applicable": n("applicable"),
        "missing_data": n("inapplicable_missing_data"),
        "out_of_scope": n("inapplicable_out_of_scope"),
        "total": F.size(vector),
    }
