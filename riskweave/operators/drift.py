"""Feature drift, label drift and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import psi_term


def feature_psi(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10, limit: float = 0.1) -> DataFrame:
    """EVA8: population stability index per feature over equal-width bins of the reference range.

    The last bin is closed, current values outside the range are dropped, and each
    bin share gets 1e-6. Both sides are binned in one pass in long form.
    """

    def long(df: DataFrame, side: int) -> DataFrame:
        typed = df.select(*[F.col(f).cast("double").alias(f) for f in features])
        return typed.unpivot([], features, "feature", "x").where(F.col("x").isNotNull()).withColumn("side", F.lit(side))

    ref, cur = long(reference, 0), long(current, 1)
    span = ref.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = ref.unionByName(cur).join(F.broadcast(span), "feature")  # one row per named feature
    inside = rows.where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = inside.groupBy("feature", b.cast("int").alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c")
    )
    grid = span.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    totals = counts.groupBy("feature").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    full = grid.join(counts, ["feature", "bin"], "left").na.fill(0, ["r", "c"]).join(totals, "feature")
    p = F.when(F.col("tc") > 0, F.col("c") / F.col("tc")).otherwise(0.0) + 1e-6
    q = F.col("r") / F.col("tr") + 1e-6
    out = full.groupBy("feature").agg(F.sum(psi_term(p, q)).alias("psi"))
    return out.withColumn("drifted", F.col("psi") > limit)


def label_drift(reference: DataFrame, current: DataFrame, label: str, limit: float = 0.1) -> DataFrame:
    """EVA9: absolute change of the positive rate."""
    a = reference.agg(F.avg(F.col(label).cast("double")).alias("reference_rate"))
    rate = current.agg(F.avg(F.col(label).cast("double"))).scalar()
    shift = F.abs(F.col("current_rate") - F.col("reference_rate"))
    return a.withColumn("current_rate", rate).withColumns({"rate_shift": shift, "drifted": shift > limit})


def leakage(features: DataFrame) -> DataFrame:
    """EVA7: first transfers of a sender that carry information from later rows; all counts must be 0."""
    first = features.where(F.col("is_first_send"))
    return first.agg(
        F.count(F.lit(1)).alias("first_rows"),
        F.count_if(F.col("amount_deviation") != 0).alias("bad_deviation"),
        F.count_if(F.col("time_since_prev_out") != 0).alias("bad_gap"),
    )


def split_overlap(split: DataFrame, key: str) -> DataFrame:
    """EVA7: keys that occur in more than one part of a split."""
    n = split.groupBy(key).agg(F.countDistinct("split").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("shared_keys"), F.count(F.lit(1)).alias("keys"))


