"""Suspicious transfers and the wallets they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.risk import label_is_suspicious


def suspicious(settings: Settings = DEFAULTS, label: str = "label") -> Column:
    """SEL1: score above the decision line, any raised level, a bad label, or a fired rule with confidence."""
    zero = F.lit(0.0)
    rule = (F.coalesce(F.col("heuristic_triggered_count"), F.lit(0)) > 0) & (
        F.coalesce(F.col("heuristic_top_confidence"), zero) >= settings.min_rule_confidence
    )
    return (
        (F.coalesce(F.col("meta_score"), zero) >= settings.thresholds.decision)
        | F.coalesce(F.col("risk_level"), F.lit("")).isin("high", "medium", "medium-low")
        | label_is_suspicious(F.col(label))
        | rule
    )


def touched_wallets(tx: DataFrame) -> DataFrame:
    """SEL2: both ends of each transfer, empty ones removed."""
    both = tx.select(F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet"))
    return both.where(F.col("wallet").isNotNull() & (F.col("wallet") != "")).distinct()


def high_risk_wallets(scored: DataFrame, threshold: float = 0.75) -> DataFrame:
    """SEL3: wallets on a transfer whose score reaches the threshold."""
    return touched_wallets(scored.where(F.col("meta_score") >= threshold))
