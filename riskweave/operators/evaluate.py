"""Classification, ranking and calibration metrics as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import precision_recall_points
from .ordered import ordered_scan


def _ratio(a, b):
    return F.when(b != 0, a / b).otherwise(0.0)


def classification(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """EVA1: precision, recall, F1, balanced accuracy, MCC, Brier score and the confusion counts."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier_score"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    pr, rc = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    spec = _ratio(tn, tn + fp)
    balanced = F.when(tp + fn == 0, spec).when(tn + fp == 0, rc).otherwise((rc + spec) / 2)
    mcc = _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        "tp", "fp", "fn", "tn", pr.alias("precision"), rc.alias("recall"), _ratio(2 * pr * rc, pr + rc).alias("f1"),
        balanced.alias("balanced_accuracy"), mcc.alias("mcc"), "brier_score",
    )


def ranking_areas(df: DataFrame, label: str, score: str, hot_rows: int | None = None) -> DataFrame:
    """EVA2: average precision (equal scores as one step) and ROC area (equal scores count half); 0 for one class."""
    pts = precision_recall_points(df, label, score, hot_rows)
    totals = df.agg(F.sum(F.col(label).cast("bigint")).alias("np"), F.count(F.lit(1)).alias("nn"))
    np_, all_ = totals.first()
    np_ = np_ or 0
    nn = all_ - np_
    neg, fp_before = F.col("cnt") - F.col("pos"), F.col("predicted") - F.col("tp") - (F.col("cnt") - F.col("pos"))
    ap = F.sum(F.col("pos") * F.col("precision"))
    below = F.lit(nn) - fp_before - neg
    roc = F.sum(F.col("pos") * (below + neg / 2.0))
    if np_ == 0 or nn == 0:
        return totals.select(F.lit(0.0).alias("pr_auc"), F.lit(0.0).alias("roc_auc"))
    return pts.agg((ap / np_).alias("pr_auc"), (roc / (float(np_) * nn)).alias("roc_auc"))


def ranking_at_k(df: DataFrame, label: str, score: str, tie: str, ks=(50, 100, 200, 500)) -> DataFrame:
    """EVA3: precision and recall of the k best scores, ties to the larger id; ``limit`` is a per-task top-k."""
    top = df.select(label, score, tie).orderBy(F.col(score).desc(), F.col(tie).desc()).limit(max(max(ks), 1))
    ranked = ordered_scan(top, [], [f"-{score}", f"-{tie}"], index="_i")
    total = df.agg(F.sum(F.col(label).cast("bigint"))).scalar()
    aggs = []
    for k in ks:
        inside = F.col("_i") <= k
        aggs += [F.sum(F.when(inside, F.col(label)).otherwise(0)).alias(f"h{k}"), F.count_if(inside).alias(f"n{k}")]
    row = ranked.agg(*aggs)
    out = row.select(
        *[F.when(F.col(f"n{k}") > 0, F.col(f"h{k}") / F.col(f"n{k}")).otherwise(0.0).alias(f"precision_at_{k}") for k in ks],
        *[F.when(total > 0, F.coalesce(f"h{k}", F.lit(0)) / total).otherwise(0.0).alias(f"recall_at_{k}") for k in ks],
    )
    return out


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """EVA5: expected calibration error over equal-width bins, the last one closed."""
    b = reduce(lambda x, y: x + y, [(F.col(score) >= i * (1.0 / bins)).cast("int") for i in range(1, bins)])
    per = df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("acc"), F.avg(score).alias("conf")
    )
    return per.agg(
        F.coalesce(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), F.lit(0.0)).alias("ece")
    )


def per_class(df: DataFrame, label: str, score: str, hot_rows: int | None = None) -> DataFrame:
    """EVA6: one-versus-rest PR area and the report at 0.5 for both classes."""
    pos = df.select(F.lit(1).alias("class"), F.col(label).alias("y"), F.col(score).alias("s"))
    neg = df.select(F.lit(0).alias("class"), (1 - F.col(label)).alias("y"), (1 - F.col(score)).alias("s"))
    out = None
    for part in (pos, neg):
        report = classification(part.withColumn("p", (F.col("s") >= 0.5).cast("int")), "y", "p", "s")
        area = ranking_areas(part, "y", "s", hot_rows)
        cls = 1 if out is None else 0
        row = report.select(
            F.lit(cls).alias("class"), "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"),
            area.select("pr_auc").scalar().alias("pr_auc"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def metric_rows(df: DataFrame, model: str, cohort: str, time: str, label: str, predicted: str, score: str, width: str = "1 day") -> DataFrame:
    """EVA10: long-format metric rows per cohort and time window."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    per = df.groupBy(F.col(cohort).alias("cohort_key"), F.window(time, width).alias("w")).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier_score"), F.count(F.lit(1)).cast("double").alias("row_count"),
    )
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    wide = per.select(
        "cohort_key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), "brier_score", "row_count",
    )
    return wide.unpivot(
        ["cohort_key", "window_start", "window_end"], ["precision", "recall", "brier_score", "row_count"], "metric_name", "metric_value"
    ).select(F.lit(model).alias("model_name"), "cohort_key", "metric_name", "metric_value", "window_start", "window_end")


def metrics_named(rows: DataFrame, name: str | None = None, prefix: str | None = None) -> DataFrame:
    """FIL4: metric rows by exact name or by name prefix."""
    return rows.where(F.col("metric_name") == name) if name else rows.where(F.col("metric_name").like(f"{prefix}%"))
