"""Sorted pages, latest rows and run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """TOP1: one page in the given order, with the exact total; order and limit run as a per-task top-k."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def latest(df: DataFrame, column: str, n: int) -> DataFrame:
    """WIN12: the n newest rows."""
    return df.orderBy(F.col(column).desc()).limit(n)


def dashboard(runs: DataFrame, newest: int | None = None) -> DataFrame:
    """AGG14: totals over all runs, or the ``newest`` ones if a number is given, and the latest completed one."""
    r = runs if newest is None else latest(runs, "created_at", newest)
    done = F.col("status") == "completed"
    return r.agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(done).alias("completed_runs"), F.sum("total_txns").alias("total_txns"),
        F.sum("suspicious_tx_count").alias("suspicious_txns"), F.sum("cluster_count").alias("clusters"),
        F.max_by(F.when(done, F.col("run_id")), F.when(done, F.col("created_at"))).alias("latest_completed"),
    )


def filtered(tx: DataFrame, scores: DataFrame | None = None, label: str | None = None, min_risk: float | None = None) -> DataFrame:
    """FIL3 / JOI3: by label and, joined with scores, by minimum score."""
    if label is not None:
        tx = tx.where(F.col("label") == label)
    if min_risk is None:
        return tx
    return tx.join(scores.where(F.col("meta_score") >= min_risk), "transaction_id")
