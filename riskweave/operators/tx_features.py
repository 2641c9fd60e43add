"""Per-transfer features: amounts, fees and per-wallet ordered statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scalars import fee_ratio, is_round_amount, log_amount, seconds_after
from .ordered import ordered_scan

ORDER = ["timestamp", "ord"]


def amount_features(tx: DataFrame) -> DataFrame:
    """SCA1-SCA3."""
    return tx.withColumns(
        {
            "log_amount": log_amount(F.col("amount")),
            "is_round_amount": is_round_amount(F.col("amount")),
            "fee_ratio": fee_ratio(F.col("fee"), F.col("amount")),
        }
    )


def activity_counts(tx: DataFrame) -> DataFrame:
    """WIN1: transfers per sender and per receiver, as aggregates joined back."""
    return tx.join(sender_counts(tx), "sender_wallet", "left").join(receiver_counts(tx), "receiver_wallet", "left")


def sender_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("sender_wallet").agg(F.count(F.lit(1)).alias("sender_tx_count"))


def receiver_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("receiver_wallet").agg(F.count(F.lit(1)).alias("receiver_tx_count"))


def receive_gaps(tx: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """WIN3: seconds since the receiver's previous receipt, 0 for the first."""
    out = ordered_scan(tx, ["receiver_wallet"], ORDER, lag={"_prev": "timestamp"}, hot_rows=hot_rows)
    return out.withColumn("time_since_prev_in", F.coalesce(seconds_after("timestamp", "_prev"), F.lit(0.0))).drop("_prev")


def send_history(tx: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """WIN2 + WIN6 in one scan of the sender's rows, plus the raw gap WIN5 aggregates."""
    out = ordered_scan(
        tx, ["sender_wallet"], ORDER, lag={"_prev": "timestamp"}, moments={"_a": "amount"}, hot_rows=hot_rows
    )
    z = (F.col("amount") - F.col("_a_mean")) / F.col("_a_std")
    out = out.withColumns(
        {
            "send_gap": seconds_after("timestamp", "_prev"),
            "amount_deviation": F.when(F.col("_a_std") > 0, z).otherwise(0.0),
        }
    )
    return out.withColumn("time_since_prev_out", F.coalesce("send_gap", F.lit(0.0))).drop("_prev", "_a_mean", "_a_std")


def repeat_index(tx: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """WIN4: running number of the transfer between its sender and receiver."""
    return ordered_scan(tx, ["sender_wallet", "receiver_wallet"], ORDER, index="sender_repeat_count", hot_rows=hot_rows)


def burstiness(with_gap: DataFrame) -> DataFrame:
    """WIN5: spread of a sender's gaps over its whole history, 0 below three timestamps."""
    return with_gap.groupBy("sender_wallet").agg(
        F.when(F.count("timestamp") >= 3, F.stddev_pop("send_gap")).otherwise(0.0).alias("burstiness_score")
    )


def transaction_features(tx: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All per-transfer features.

    Everything keyed by the sender comes first and shares one shuffle (the gap
    spread and the sender count aggregate rows already grouped by sender); the pair
    index and the receiver statistics follow with one shuffle each.
    """
    hot = settings.hot_rows
    history = send_history(amount_features(tx), hot)
    per_sender = history.groupBy("sender_wallet").agg(
        F.when(F.count("timestamp") >= 3, F.stddev_pop("send_gap")).otherwise(0.0).alias("burstiness_score"),
        F.count(F.lit(1)).alias("sender_tx_count"),
    )
    out = history.join(per_sender, "sender_wallet", "left").drop("send_gap")
    out = receive_gaps(repeat_index(out, hot), hot)
    return out.join(receiver_counts(tx), "receiver_wallet", "left")
