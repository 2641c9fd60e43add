"""Run and case reports as rows and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .views import with_level

# Sentence formats of the run summary.
SUMMARY_LINE = "Transfers: %d. Flagged: %d. Groups: %d. Decision limit: %.4f."
BANDS_LINE = "Transfers per level: %s."
REVIEW_LINE = "Highest scores: %s; the first has %.4f and level %s."
NO_REVIEW_LINE = "No transfer is flagged."
THEMES_LINE = "Typologies of the groups: %s."
OPEN_LINE = "The groups have no typology."
NO_CLUSTERS_LINE = "No groups were formed."


def score_distribution(scores: DataFrame) -> DataFrame:
    """AGG12: number of transfers per level, absent levels as 0."""
    return scores.agg(*[F.count_if(F.col("risk_level") == x).alias(x.replace("-", "_")) for x in ("high", "medium", "medium-low", "low")])


def top_suspicious(suspicious: DataFrame, k: int = 20) -> DataFrame:
    """TOP3: the k highest scores, rounded half-even to four decimals, ties in input order."""
    best = suspicious.orderBy(F.col("meta_score").desc(), "ord").limit(k)
    cols = ["meta_score", "behavioral_score", "graph_score", "entity_score", "temporal_score", "offramp_score"]
    return best.select("transaction_id", "risk_level", F.col("heuristic_top_typology").alias("typology"), "ord", *[F.bround(c, 4).alias(c) for c in cols])


def summary_row(scores: DataFrame, suspicious: DataFrame, clusters: DataFrame, files: int = 1, settings: Settings = DEFAULTS) -> DataFrame:
    """REP1: counts of the run and its score distribution in one row."""
    d = score_distribution(scores)
    return d.select(
        F.lit(files).alias("total_files"),
        scores.agg(F.count(F.lit(1))).scalar().alias("total_transactions"),
        suspicious.agg(F.count(F.lit(1))).scalar().alias("suspicious_transactions"),
        clusters.agg(F.count(F.lit(1))).scalar().alias("cluster_count"),
        F.lit(settings.thresholds.decision).alias("threshold_used"), "*",
    )


def cluster_findings(clusters: DataFrame) -> DataFrame:
    """REP1: clusters with level."""
    return with_level(clusters).select("cluster_id", "label", "typology", "risk_score", "risk_level", "wallet_count", "tx_count", "total_amount")


def run_document(run_id: str, summary: DataFrame, top: DataFrame, findings: DataFrame) -> DataFrame:
    """REP1 / SNK5: the run's document as rows: the first with counts and the top rows, then one per cluster."""
    t = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("meta_score")).alias("r"), "ord", *[c for c in top.columns if c != "ord"]))).alias("t"))
    head = summary.select(F.lit(run_id).alias("run_id"), F.struct(*summary.columns).alias("summary"), t.scalar().alias("top_suspicious_transactions"))
    each = findings.select(F.lit(run_id).alias("run_id"), F.struct(*findings.columns).alias("cluster_finding"))
    return head.unionByName(each, allowMissingColumns=True)


def run_summary(summary: DataFrame, top: DataFrame, findings: DataFrame, max_words: int = 100) -> DataFrame:
    """REP2: bullet lines, dropped from the end until the block has at most ``max_words`` words."""
    best = top.orderBy(F.col("meta_score").desc(), "ord").limit(4)
    ids = best.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("meta_score")).alias("r"), "ord", "transaction_id", "risk_level"))), lambda x: x).alias("b")).scalar()
    six = findings.orderBy(F.col("risk_score").desc(), "cluster_id").limit(6)
    types = six.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("risk_score")).alias("r"), "cluster_id", "typology"))), lambda x: x["typology"])).scalar()
    s = summary.withColumns({"_best": ids, "_types": types})
    bands = F.filter(
        F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{n}:"), F.col(c).cast("string"))) for n, c in (("high", "high"), ("medium", "medium"), ("medium-low", "medium_low"), ("low", "low"))]),
        lambda x: x.isNotNull(),
    )
    themes = F.slice(F.array_distinct(F.filter("_types", lambda x: x.isNotNull() & (F.trim(x) != ""))), 1, 4)
    lines = F.array(
        F.format_string(SUMMARY_LINE, "total_transactions", "suspicious_transactions", "cluster_count", "threshold_used"),
        F.format_string(BANDS_LINE, F.array_join(bands, ", ")),
        F.when(F.size("_best") > 0, F.format_string(
            REVIEW_LINE, F.array_join(F.transform("_best", lambda x: x["transaction_id"]), ", "), -F.col("_best")[0]["r"], F.col("_best")[0]["risk_level"]
        )).otherwise(NO_REVIEW_LINE),
        F.when(F.size(themes) > 0, F.format_string(THEMES_LINE, F.array_join(themes, ", "))).when(F.col("cluster_count") > 0, OPEN_LINE).otherwise(NO_CLUSTERS_LINE),
    )

    def block(n: int):
        return F.array_join(F.transform(F.slice(lines, 1, n), lambda x: F.concat(F.lit("• "), x)), "\n")

    out = None
    for n in (4, 3, 2):
        fits = F.size(F.split(block(n), r"\s+")) <= max_words
        out = F.when(fits, block(n)) if out is None else out.when(fits, block(n))
    return s.select(out.otherwise(block(1)).alias("summary_text"), F.size(lines).alias("n_lines"))


def case_report(cases: DataFrame, members: DataFrame) -> DataFrame:
    """REP3: case columns with the number of wallets and the smallest one; the wallets stay rows."""
    m = members.groupBy(F.col("cluster_id").alias("case_id")).agg(F.count(F.lit(1)).alias("n_wallets"), F.min("wallet").alias("primary_wallet"))
    return cases.join(m, "case_id", "left")


def as_json(df: DataFrame, out: str = "document") -> DataFrame:
    """SNK5: one JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))
