"""Training tables: labels, splits, class weights, oversampling and feature preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import META_COLUMNS, fixed_columns
from .ordered import ordered_scan


def binary_label(label: Column) -> Column:
    return F.when(label == "illicit", 1).when(label.isNotNull(), 0)


def wallet_labels(tx: DataFrame) -> DataFrame:
    """AGG16: the largest label over both roles of a wallet's labelled transfers."""
    t = tx.withColumn("y", binary_label(F.col("label"))).where(F.col("y").isNotNull())
    return t.select("y", F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet")).groupBy("wallet").agg(F.max("y").alias("label"))


def labelled_wallets(tx: DataFrame) -> DataFrame:
    """AGG16 as the nodes of TRN1: (node_id, label, amount, timestamp, fee, ord), the largest amount with its fee, the latest time and the first place of a wallet's labelled transfers."""
    t = tx.where(binary_label(F.col("label")).isNotNull())
    ends = t.select("label", "amount", "timestamp", "fee", "ord", F.explode(F.array_distinct(F.array("sender_wallet", "receiver_wallet"))).alias("node_id"))
    return ends.where(F.col("node_id").isNotNull() & (F.col("node_id") != "")).groupBy("node_id").agg(
        F.when(F.max(binary_label(F.col("label"))) == 1, "illicit").otherwise("licit").alias("label"), F.max("amount").alias("amount"),
        F.max("timestamp").alias("timestamp"), F.max_by("fee", F.struct("amount", "ord")).alias("fee"), F.min("ord").alias("ord"),
    )


def stratified_split(
    df: DataFrame, label: str, key: str, parts: dict[str, float], seed: int = 42, shuffle: Column | None = None, hot_rows: int | None = None
) -> DataFrame:
    """TRN2: each label is cut at the same shares of a shuffled order; ``shuffle`` overrides the hash order.

    The position inside a label comes from an ordered scan, so a label holding most rows is no single task.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit(seed)) if shuffle is None else shuffle
    ranked = ordered_scan(df.withColumn("_h", order), [label], ["_h", key], index="_i", hot_rows=hot_rows)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    pos = (F.col("_i") - 1) / F.col("_n")
    return _cut(ranked.join(sizes, label), pos, parts).drop("_h", "_i", "_n")


def time_split(df: DataFrame, order: list[str], parts: dict[str, float], hot_rows: int | None = None) -> DataFrame:
    """TRN3: chronological parts that do not overlap."""
    ranked = ordered_scan(df, [], order, index="_i", hot_rows=hot_rows)
    n = df.agg(F.count(F.lit(1))).scalar()
    return _cut(ranked, (F.col("_i") - 1) / n, parts).drop("_i")


def _cut(df: DataFrame, pos: Column, parts: dict[str, float]) -> DataFrame:
    edge, out = 0.0, None
    for name, share in parts.items():
        edge += share
        hit = pos < round(edge, 9)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return df.withColumn("split", out.otherwise(list(parts)[-1]))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """TRN4: weight of the positive class."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weight(df, label).select("scale_pos_weight").scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, w).otherwise(1.0))


def oversample(df: DataFrame, label: str) -> DataFrame:
    """TRN4: positives repeated ``max(floor(neg/pos) - 1, 1)`` more times; copies are made inside each task."""
    n_pos, n_neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if not n_pos:
        return df.withColumn("copy", F.lit(0))
    extra = max(n_neg // n_pos - 1, 1)
    copies = F.when(F.col(label) == 1, F.sequence(F.lit(0), F.lit(int(extra)))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(copies))


def scored_training_rows(features: DataFrame, scores: DataFrame, key: str = "transaction_id") -> DataFrame:
    """TRN5: training rows with their scores and the number of lenses that gave one."""
    from ..config import LENS_SCORES

    n = sum((F.coalesce(F.col(c), F.lit(0.0)) != 0).cast("int") for c in LENS_SCORES)
    return features.join(scores, key, "left").withColumn("n_lenses_available", n.cast("double"))


def meta_table(df: DataFrame, keep: list[str]) -> DataFrame:
    """TRN6: label and the seventeen meta columns."""
    return fixed_columns(df, META_COLUMNS, keep)


def illicit_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("rate"))


def subset(edges: DataFrame, features: DataFrame, labels: DataFrame, wallets: DataFrame) -> dict[str, DataFrame]:
    """FIL6: edges with both ends in the set, features by sender, labels by wallet."""
    from .graph import induced

    return {
        "edges": induced(edges, wallets),
        "features": features.join(wallets.select(F.col("wallet").alias("sender_wallet")).distinct(), "sender_wallet", "left_semi"),
        "labels": labels.join(wallets.select("wallet").distinct(), "wallet", "left_semi"),
    }
