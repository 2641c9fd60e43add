"""Coercion, null handling, outlier cap, deduplication and ordering of raw transfers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COLUMN_TYPES, DEFAULTS, OPTIONAL_COLUMNS, Settings
from .ordered import exact_quantile, ordered_scan

# Accepted column names, most specific first.
ALIASES = {
    "transaction_id": ["transaction_id", "id", "tx_id"],
    "sender_wallet": ["sender_wallet", "sender", "from", "from_address"],
    "receiver_wallet": ["receiver_wallet", "receiver", "to", "to_address"],
    "amount": ["amount", "value"],
    "asset_type": ["asset_type", "token"],
    "timestamp": ["timestamp", "block_timestamp", "time"],
}


def resolve_aliases(df: DataFrame) -> DataFrame:
    """CLN7: rename alias columns; the first non-missing alias wins, an empty wallet counts as missing."""
    have = set(df.columns)
    out: list[Column] = []
    used: set[str] = set()
    for target, names in ALIASES.items():
        present = [n for n in names if n in have]
        if not present:
            continue
        used.update(present)
        parts = [F.col(f"`{n}`") for n in present]
        if target.endswith("_wallet"):
            parts = [F.nullif(p.cast("string"), F.lit("")) for p in parts]
        out.append(F.coalesce(*parts).alias(target))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in used])


def coerce_types(df: DataFrame) -> DataFrame:
    """CLN1: bad amount becomes 0, bad timestamp or fee becomes null, ids become text."""
    ts = df.schema["timestamp"].dataType.typeName()
    stamp = F.try_to_timestamp(F.col("timestamp")) if ts == "string" else F.col("timestamp").cast("timestamp")

    def number(name: str) -> Column:
        return F.col(name).try_cast("double")

    out = df.withColumns(
        {
            "amount": F.coalesce(F.nanvl(number("amount"), F.lit(None).cast("double")), F.lit(0.0)),
            "timestamp": stamp,
            "transaction_id": F.col("transaction_id").cast("string"),
            "sender_wallet": F.col("sender_wallet").cast("string"),
            "receiver_wallet": F.col("receiver_wallet").cast("string"),
        }
    )
    return out.withColumn("fee", number("fee")) if "fee" in df.columns else out


def drop_incomplete(df: DataFrame) -> DataFrame:
    """CLN2: rows without sender, receiver, amount or timestamp are removed."""
    return df.na.drop(subset=["sender_wallet", "receiver_wallet", "amount", "timestamp"])


def add_optional_columns(df: DataFrame) -> DataFrame:
    """CLN3: optional columns that are absent are added as nulls."""
    missing = [c for c in OPTIONAL_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast(COLUMN_TYPES.get(c, "string")) for c in missing}) if missing else df


def clip_outliers(df: DataFrame, settings: Settings = DEFAULTS, cap_amounts: bool = True) -> DataFrame:
    """CLN4: cap the amount at its ``clip_quantile`` quantile, unless the caller asks not to."""
    if not cap_amounts or df.isEmpty():
        return df
    cap = exact_quantile(df, "amount", settings.clip_quantile, settings.hot_rows)
    return df.withColumn("amount", F.least(F.col("amount"), F.lit(cap)))


def clean(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """CLN1-CLN4 in order."""
    return clip_outliers(add_optional_columns(drop_incomplete(coerce_types(df))), settings)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """CLN5: the first row per key in input order.

    ``min_by`` aggregates partially before the shuffle, so a key repeated very
    often never gathers its copies in one task. Null keys form one group.
    """
    rest = [c for c in df.columns if c not in key]
    firsts = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return firsts.select(*[F.col(k) for k in key], *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def add_position(df: DataFrame, order: Sequence[str] = ("timestamp", "ord"), out: str = "position", hot_rows=None):
    """CLN6: global time order as a column, so later steps need no global sort."""
    return ordered_scan(df, [], list(order), index=out, hot_rows=hot_rows)


def storage_rows(df: DataFrame) -> DataFrame:
    """CLN8: the eleven stored columns, timestamp as text, nulls kept."""
    return add_optional_columns(df).select(
        F.coalesce(F.col("transaction_id"), F.lit("")).alias("transaction_id"),
        F.coalesce(F.col("sender_wallet"), F.lit("")).alias("sender_wallet"),
        F.coalesce(F.col("receiver_wallet"), F.lit("")).alias("receiver_wallet"),
        F.col("amount").cast("double").alias("amount"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "tx_hash",
        "asset_type",
        "chain_id",
        "fee",
        "label",
        "label_source",
    )


def between_times(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """FIL1: inclusive time range, each end optional."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def trailing_hours(df: DataFrame, hours: int = 24) -> DataFrame:
    """FIL2: rows in the last ``hours`` (at least 1) before the latest timestamp, both ends included."""
    latest = df.agg(F.max("timestamp")).scalar()
    return df.where(F.col("timestamp") >= latest - F.expr(f"INTERVAL {max(1, int(hours))} HOURS"))
