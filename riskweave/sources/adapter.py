"""Transfer view over an ``events`` table, plus table loading by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Wallet-to-wallet transfers derived from user events; ``ord`` is the input order."""
    events = table(spark, folder, "events")
    users = events.agg(F.countDistinct("user_id")).scalar()
    lane = F.floor(F.col("event_id") / F.lit(7.0)).cast("bigint") % 7
    sender = F.col("user_id") * 1000 + F.col("event_id") % 7
    receiver = ((F.col("user_id") * 7 + F.col("event_id")) % users) * 1000 + lane
    return events.select(
        F.concat(F.lit("tx_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.concat(F.lit("w"), sender.cast("string")).alias("sender_wallet"),
        F.concat(F.lit("w"), receiver.cast("string")).alias("receiver_wallet"),
        F.round(F.col("value") * 100, 0).alias("amount"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.round(F.col("value") * (F.col("event_id") % 5) * 0.01, 4).alias("fee"),
        F.col("event_type").alias("asset_type"),
        F.when(F.col("user_id") % 10 == 0, "bitcoin").otherwise("ethereum").alias("chain_id"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 120), "illicit")
        .when(F.col("event_type").isin("purchase", "signup"), "licit")
        .alias("label"),
        F.col("event_id").cast("bigint").alias("ord"),
    )


def large_transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Transfers of 15,000 and more: a second, smaller table for upserts, appends and lookups."""
    return transfers(spark, folder).where(F.col("amount") >= 15000)


def cell_transfers(spark: SparkSession, folder: str) -> DataFrame:
    """All transfers again, between wallets of small cells: a sparse graph of many components.

    Twenty consecutive events share a cell of seven wallets; the first event of every
    other cell pays into the next one.
    """
    t = transfers(spark, folder)
    user = F.col("sender_wallet").substr(F.lit(2), F.length("sender_wallet")).cast("bigint")
    cell = F.floor(F.col("ord") / F.lit(20.0)).cast("bigint")
    into = cell + F.when(F.col("ord") % 40 == 0, 1).otherwise(0)
    sender = cell * 10 + F.floor(user / F.lit(1000.0)).cast("bigint") % 7
    receiver = into * 10 + (F.floor(user / F.lit(1000.0)).cast("bigint") * 3 + F.col("ord")) % 7
    return t.withColumns({
        "sender_wallet": F.concat(F.lit("v"), sender.cast("string")),
        "receiver_wallet": F.concat(F.lit("v"), receiver.cast("string")),
    })
