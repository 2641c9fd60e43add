"""Incremental ingest, sliding activity and micro-batch scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..operators.cleaning import add_optional_columns, coerce_types, drop_incomplete
from ..operators.selection import suspicious

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clean_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR1: typed, complete rows; an id repeated within ``delay`` is dropped. State is bounded by the watermark."""
    rows = add_optional_columns(drop_incomplete(coerce_types(stream)))
    return rows.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def _seconds(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL '{interval}')").first()[0]


def velocity_stream(stream: DataFrame, delay: str = "1 hour", width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """STR2: transfers, volume and sub-threshold count per wallet and slot of length ``slide``; ``sliding`` makes windows of ``width`` of them.

    A transfer counts in one slot, however many windows have it, so state has one row per wallet and slot. A slot is closed and leaves the state
    when the watermark (latest time less ``delay``) passes the end of the last window that has it; rows for slots that are closed by then are dropped.
    """
    w, s = (_seconds(stream.sparkSession, x) for x in (width, slide))
    if w % s:
        raise ValueError(f"windows of {width} are not made of whole slots of {slide}")
    kept = f"{_seconds(stream.sparkSession, delay) + w - s} seconds"
    both = stream.select("timestamp", "amount", F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet"))
    a = F.col("amount")
    return both.withWatermark("timestamp", kept).groupBy(F.window("timestamp", slide), "wallet").agg(
        F.count(F.lit(1)).alias("n_tx"), F.count_if((a > 0) & (a < 10000)).alias("n_below"), F.sum("amount").alias("volume")
    )


#: Slots that a task spreads over their windows at a time.
SLOTS = 200_000


def sliding(slots: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """STR2: (wallet, window, n_tx, n_below, volume) from stored slots with their ``batch_id``; of a slot stored several times the last counts.

    Slots are shuffled once, by wallet; the windows of a wallet are summed where its slots are.
    """
    spark = slots.sparkSession
    w, s = (_seconds(spark, x) for x in (width, slide))
    sums = ["n_tx", "n_below", "volume"]
    parts = max(-(-slots.count() // SLOTS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = slots.select("wallet", F.unix_seconds("window.start").alias("at"), F.struct("batch_id", *sums).alias("row")).repartition(parts, "wallet")
    last = own.groupBy("wallet", "at").agg(F.max_by("row", "row.batch_id").alias("row"))
    begun = F.explode(F.sequence(F.col("at") - F.lit(w - s), F.col("at"), F.lit(s)))
    out = last.select("wallet", begun.alias("at"), *[F.col(f"row.{c}") for c in sums]).groupBy("wallet", "at").agg(*[F.sum(c).alias(c) for c in sums])
    window = F.struct(F.timestamp_seconds("at").alias("start"), F.timestamp_seconds(F.col("at") + w).alias("end"))
    return out.select("wallet", window.alias("window"), *sums)


def _appended(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Appends every micro-batch in a folder of its own, overwritten when the batch is retried, so a restart adds no row twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def closed_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STR2: append each row of an aggregated stream once it is closed."""
    return _appended(stream, path, checkpoint)


def latest_result(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """STR2: append the rows of an aggregated stream that a micro-batch changed, closed or not; of a row stored several times the last counts.

    State lies in RocksDB, so that it isn't bounded by the heap.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKS)
    try:
        return _appended(stream, path, checkpoint, mode="update")
    finally:
        conf.set(key, before)


def score_stream(stream: DataFrame, rules: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS) -> StreamingQuery:
    """STR3: score each micro-batch with stored wallet rules and append its suspicious rows."""

    def scored(batch: DataFrame) -> DataFrame:
        from ..plans.scoring import score_transfers

        keep = ["transaction_id", "meta_score", "risk_level", "heuristic_triggered_count", "heuristic_top_typology"]
        return score_transfers(batch, rules, None, None, settings).where(suspicious(settings)).select(*keep)

    return _appended(stream, path, checkpoint, scored)
