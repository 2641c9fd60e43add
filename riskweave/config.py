"""Tunable settings. Every default is a plain value so a run can override any of them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column contract of a transfer table.
REQUIRED_COLUMNS = ["transaction_id", "sender_wallet", "receiver_wallet", "amount", "timestamp"]
OPTIONAL_COLUMNS = ["tx_hash", "asset_type", "chain_id", "fee", "label", "label_source"]
COLUMN_TYPES = {"amount": "double", "fee": "double", "timestamp": "timestamp"}

N_RULES = 185
FIRED_EPS = 1e-9


@dataclass(frozen=True)
class Thresholds:
    """Score cut-offs used when no trained policy is supplied."""

    decision: float = 0.75
    high: float = 0.9
    low: float = 0.3


# Weights of the fallback fusion.
FUSION_WEIGHTS = {
    "behavioral_score": 0.225,
    "graph_score": 0.175,
    "entity_score": 0.125,
    "temporal_score": 0.175,
    "offramp_score": 0.125,
    "heuristic_max": 0.175,
}

LENS_SCORES = [
    "behavioral_score",
    "behavioral_anomaly_score",
    "graph_score",
    "entity_score",
    "temporal_score",
    "offramp_score",
]


@dataclass(frozen=True)
class Settings:
    """Run settings. ``hot_rows`` is the size from which one window group is split over several tasks."""

    thresholds: Thresholds = field(default_factory=Thresholds)
    hot_rows: int = 2_000_000
    window_hours: int = 24
    sync_seconds: int = 60
    clip_quantile: float = 0.999
    risky_pagerank: float = 0.01
    min_rule_confidence: float = 0.15
    sequence_length: int = 50


DEFAULTS = Settings()
