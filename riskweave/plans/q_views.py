"""Queries over analyst views, reports and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import level_rank
from ..operators import clusters as cl
from ..operators import filing, reports, views
from ..operators.components import connected_components
from ..operators.rules.registry import RuleBook
from ..session import cut_lineage
from ..sources.adapter import cell_transfers
from .catalog import query
from .q_joins import SC, scored
from .q_runs import cases
from .q_scalars import LEVEL
from .scoring import build_graph
from .sql import D, I, S, T, select, sql

# A derived run over the cell transfers: scores from the row number, components as clusters.
RISK = "(ord * 37 % 1000) / 1000.0::DOUBLE"
V = {
    "rows_s": f"SELECT t.*, {RISK} AS meta_score, {LEVEL.format(s=RISK)} AS risk_level, CASE asset_type WHEN 'view' THEN 'PeelChain' WHEN 'click' THEN 'MuleDeposits' ELSE 'FanOutDispersal' END AS typology FROM tx_l t",
    "sus": "SELECT s.*, c.component AS cluster_id FROM rows_s s JOIN cc_l c ON c.wallet = sender_wallet WHERE meta_score >= 0.4",
    "clus": f"""SELECT *, {LEVEL.format(s='risk_score')} AS risk_level FROM (SELECT c.component AS cluster_id, count(DISTINCT c.wallet) AS wallet_count,
  (count(DISTINCT c.wallet) * 13 % 100) / 100.0::DOUBLE AS risk_score, CASE WHEN count(DISTINCT c.wallet) > 3 THEN 'fan-out' ELSE 'peel chain' END AS typology FROM cc_l c GROUP BY 1)""",
    "amounts": "SELECT component AS cluster_id, sum(amount) AS total_amount, count(*) AS tx_count FROM ed_l JOIN cc_l ON wallet = src GROUP BY 1",
}
RANK = "CASE {x} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'medium-low' THEN 1 ELSE 0 END"
NAME = "CASE {x} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'medium-low' ELSE 'low' END"


class Derived:
    """Tables of the derived run."""

    def __init__(self, spark, d):
        from ..functions.risk import level_from_score

        t = cell_transfers(spark, d)
        self.graph = build_graph(t)
        comps = cut_lineage(connected_components(self.graph.edges, self.graph.nodes))
        self.members = comps.select("wallet", F.col("component").alias("cluster_id"))
        kind = F.when(F.col("asset_type") == "view", "PeelChain").when(F.col("asset_type") == "click", "MuleDeposits").otherwise("FanOutDispersal")
        s = t.withColumns({"meta_score": F.col("ord") * 37 % 1000 / 1000.0, "typology": kind})
        self.scores = s.withColumn("risk_level", level_from_score(F.col("meta_score"))).withColumn("heuristic_top_typology", F.col("typology"))
        of = self.members.withColumnRenamed("wallet", "sender_wallet")
        self.suspicious = self.scores.where(F.col("meta_score") >= 0.4).join(of, "sender_wallet")
        n = self.members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("wallet_count"))
        facts = cl.cluster_edges(self.graph.edges, self.members).groupBy("cluster_id").agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("tx_count"))
        self.clusters = n.join(facts, "cluster_id").select(
            "cluster_id", "wallet_count", "total_amount", "tx_count", (F.col("wallet_count") * 13 % 100 / 100.0).alias("risk_score"),
            F.when(F.col("wallet_count") > 3, "fan-out").otherwise("peel chain").alias("typology"), F.format_string("Cluster (%d wallets)", "wallet_count").alias("label"),
        )


JOI4 = select(S(transaction_id="transaction_id", sender_wallet="sender_wallet", receiver_wallet="receiver_wallet", labels="CASE WHEN ord % 4 = 0 THEN '' ELSE 'PeelChain,Heuristic 999' END"),
              D(amount="amount", meta_score="meta_score"), I(heuristic_triggered_count="CASE WHEN ord % 4 = 0 THEN 7 ELSE 2 END"), tail="FROM sus", **V)


def enriched(spark, d, v=None):
    v = v or Derived(spark, d)
    stored = v.scores.select(
        "transaction_id", F.when(F.col("ord") % 4 == 0, "damaged").otherwise("[91, 999]").alias("heuristic_triggered"), F.lit(7).alias("heuristic_triggered_count"),
        F.col("typology").alias("heuristic_top_typology"), F.lit(0.5).alias("heuristic_top_confidence"),
        *[F.lit(0.0).alias(c) for c in ("entity_score", "graph_score", "behavioral_score", "temporal_score", "offramp_score")],
    )
    sus = v.suspicious.select("transaction_id", "meta_score", "risk_level", "typology", "cluster_id")
    return views.enriched_suspicious(sus, cell_transfers(spark, d), stored, RuleBook.standard().names())


def _enriched_rows(spark, d):
    return enriched(spark, d).select("transaction_id", "sender_wallet", "receiver_wallet", F.array_join("heuristic_labels", ",").alias("labels"), "amount", "meta_score", "heuristic_triggered_count")


@query("joi4", JOI4)
def joi4(spark, d):
    """Suspicious rows with transfer, score and rule names; damaged id lists fall back to the stored count."""
    return _enriched_rows(spark, d)


@query("vie1", JOI4)
def vie1(spark, d):
    """The enriched suspicious table."""
    return _enriched_rows(spark, d)


ENDS = "(SELECT sender_wallet AS wallet, * FROM sus UNION ALL SELECT receiver_wallet, * FROM sus WHERE receiver_wallet <> sender_wallet)"
BOTH_ENDS = "(SELECT sender_wallet AS wallet, * FROM sus UNION ALL SELECT receiver_wallet, * FROM sus)"  # a self-transfer counts for both


@query("vie2", select(S(wallet="wallet", risk_level=NAME.format(x="greatest(cr, coalesce(sr, 0))"), top_heuristic="CASE WHEN coalesce(sm > risk_score, false) THEN st ELSE typology END"),
                      I(cluster_count="1", suspicious_tx_count="coalesce(n, 0)"), D(risk_score="greatest(risk_score, coalesce(sm, 0))"), tail=f"""
FROM (SELECT c.wallet, k.*, {RANK.format(x='k.risk_level')} AS cr FROM cc_l c JOIN clus k ON k.cluster_id = c.component)
LEFT JOIN (SELECT wallet, count(*) n, max(meta_score) sm, max({RANK.format(x='risk_level')}) sr, arg_max(typology, (meta_score, -ord)) st FROM {BOTH_ENDS} GROUP BY 1) USING (wallet)""", **V))
def vie2(spark, d):
    v = Derived(spark, d)
    return views.run_wallets(v.members, v.clusters, v.suspicious)


VIE3 = select(S(cluster_id="cluster_id", risk_level="risk_level", typology="typology"), I(level_rank=RANK.format(x="risk_level")), D(risk_score="risk_score"), tail="FROM clus", **V)


@query("vie3", VIE3)
def vie3(spark, d):
    return views.with_level(Derived(spark, d).clusters).select("cluster_id", "risk_level", "typology", "level_rank", "risk_score")


@query("top4", VIE3)
def top4(spark, d):
    """Clusters ordered by the rank of their level."""
    return vie3(spark, d).orderBy(F.col("level_rank").desc(), F.col("risk_score").desc(), "cluster_id")


@query("top3", select(S(transaction_id="transaction_id", risk_level="risk_level", typology="typology"), D(meta_score="round_even(meta_score, 4)"), tail="FROM sus ORDER BY sus.meta_score DESC, ord LIMIT 20", **V))
def top3(spark, d):
    """The twenty highest suspicious scores."""
    s = Derived(spark, d).suspicious.withColumns({c: F.lit(0.0) for c in ("behavioral_score", "graph_score", "entity_score", "temporal_score", "offramp_score")})
    return reports.top_suspicious(s).select("transaction_id", "risk_level", "typology", "meta_score")


@query("top5", sql(f"SELECT transaction_id, CAST({RANK.format(x='risk_level')} AS BIGINT) AS rank, risk_level = 'high' AS critical FROM {SC}"))
def top5(spark, d):
    """Queue of transfers with rank and critical flag."""
    return views.risk_queue(scored(spark, d)).select("transaction_id", "rank", "critical")


@query("vie4", select(S(wallet="wallet", transaction_id="transaction_id"), D(meta_score="meta_score"), T(timestamp="timestamp"), tail=f"FROM {ENDS}", **V))
def vie4(spark, d):
    """Suspicious transfers of every wallet."""
    return views.wallet_timeline(enriched(spark, d)).select("wallet", "transaction_id", "meta_score", "timestamp")


@query("vie4_labels", sql("SELECT cluster_id, CASE WHEN count(*) FILTER (ord % 4 <> 0) > 0 THEN 'Heuristic 999,PeelChain' END AS labels FROM sus GROUP BY 1 HAVING count(*) FILTER (ord % 4 <> 0) > 0", **V))
def vie4_labels(spark, d):
    """Distinct rule labels per cluster."""
    return views.badge_labels(enriched(spark, d), "cluster_id").select("cluster_id", F.array_join("labels", ",").alias("labels"))


FLOW = f"""SELECT k.cluster_id, k.typology, coalesce(s.n, 0) AS n, least(greatest(coalesce(s.m, k.risk_score), 0), 1) AS risk, {RANK.format(x='k.risk_level')} AS kr, coalesce(s.r, 0) AS sr
FROM clus k LEFT JOIN (SELECT cluster_id, avg(meta_score) m, max({RANK.format(x='risk_level')}) r, count(*) n FROM sus GROUP BY 1) s USING (cluster_id)"""


@query("vie5", select(S(cluster_id="cluster_id", typology="typology", risk_level=NAME.format(x=f"greatest(kr, sr, {RANK.format(x=LEVEL.format(s='risk'))})")), I(n_suspicious="n"), D(risk="risk"), tail="FROM flow", flow=FLOW, **V))
def vie5(spark, d):
    """Flow summary per cluster."""
    v = Derived(spark, d)
    return views.flow_clusters(v.clusters, v.suspicious)


@query("vie5_nodes", select(S(cluster_id="c.component", wallet="c.wallet"), D(risk="coalesce(g.m, f.risk)"), tail="""FROM cc_l c JOIN flow f ON f.cluster_id = c.component
LEFT JOIN (SELECT wallet, max(meta_score) m FROM (SELECT sender_wallet AS wallet, meta_score FROM rows_s UNION ALL SELECT receiver_wallet, meta_score FROM rows_s) GROUP BY 1) g USING (wallet)""", flow=FLOW, **V))
def vie5_nodes(spark, d):
    """Node risk inside each cluster."""
    v = Derived(spark, d)
    roles = cl.flow_roles(v.graph.edges, v.members)
    return views.flow_nodes(roles, cl.wallet_notes(v.scores, v.suspicious), v.suspicious, views.flow_clusters(v.clusters, v.suspicious)).select("cluster_id", "wallet", "risk")


@query("vie5_first", sql("SELECT cluster_id, transaction_id FROM sus QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY meta_score DESC, ord) <= 12", **V))
def vie5_first(spark, d):
    """The first twelve suspicious transfers per cluster."""
    v = Derived(spark, d)
    return views.first_per_cluster(v.suspicious, [F.col("meta_score").desc(), F.col("ord")], 12).select("cluster_id", "transaction_id")


EXPL = (S(transaction_id="transaction_id", pattern_type="typology", coverage_tier="'tier0'", laundering_stage="CASE WHEN ord % 10 / 10.0 > 0.5 THEN 'integration' WHEN ord % 9 / 9.0 > 0.5 THEN 'layering' WHEN ord % 8 / 8.0 > 0.5 THEN 'placement' END",
         fired="'91,92'", top_typology_mapped="CASE typology WHEN 'PeelChain' THEN 'peel chain' WHEN 'FanOutDispersal' THEN 'fan-out' END", taxonomy_mapping_failed="typology = 'MuleDeposits'"),
        D(confidence="meta_score"))


def explained(spark, d):
    o = F.col("ord")
    s = Derived(spark, d).scores.withColumns({
        "offramp_score": o % 10 / 10.0, "graph_score": o % 9 / 9.0, "behavioral_score": o % 8 / 8.0, "entity_score": F.lit(0.05), "temporal_score": F.lit(0.0),
        "behavioral_anomaly_score": o % 3 / 3.0, "triggered_ids": F.array(F.lit(91), F.lit(92)), "heuristic_triggered_count": F.lit(2), "heuristic_top_confidence": F.lit(0.8),
    })
    return views.explanations(s)


@query("vie6", select(*EXPL, tail="FROM rows_s", **V))
def vie6(spark, d):
    """Explanation rows without the text."""
    return explained(spark, d).select("transaction_id", "pattern_type", "coverage_tier", "laundering_stage", "fired", "top_typology_mapped", "taxonomy_mapping_failed", "confidence")


@query("sca15", select(S(transaction_id="transaction_id"), I(n_active_lenses="(ord % 10 / 10.0 > 0.1)::INT + (ord % 9 / 9.0 > 0.1)::INT + (ord % 8 / 8.0 > 0.1)::INT + (ord % 3 / 3.0 > 0.1)::INT"),
                       S(high="meta_score >= 0.9", anomaly="ord % 3 = 2"), tail="FROM rows_s", **V))
def sca15(spark, d):
    """Audit fields, and the sentences the text must contain."""
    e = explained(spark, d)
    return e.select("transaction_id", "n_active_lenses", F.col("summary").contains("level HIGH").alias("high"), F.col("summary").contains("reconstruction model expects").alias("anomaly"))


def typed_cases(spark, d):
    return cases(spark, d).withColumn("typology", F.when(F.col("component_size") > 4, "Layering").otherwise("mixed"))


HIGH = {"high": f"SELECT sender_wallet AS wallet FROM {SC} WHERE meta_score >= 0.75 UNION SELECT receiver_wallet FROM {SC} WHERE meta_score >= 0.75",
        "kase": """SELECT c.component AS case_id, c.n AS wallet_count, z.n AS size, c.n / z.n AS risk, e.a AS amount, e.lo, e.hi, c.w AS primary_wallet
FROM (SELECT component, count(*) n, min(wallet) w FROM cc_l WHERE wallet IN (SELECT wallet FROM high) GROUP BY 1 HAVING count(*) >= 3) c
JOIN (SELECT component, count(*) n FROM cc_l GROUP BY 1) z USING (component) JOIN (SELECT component, sum(amount) a, min(timestamp) lo, max(timestamp) hi FROM ed_l JOIN cc_l ON wallet = src GROUP BY 1) e USING (component)"""}


@query("vie7", select(S(case_id="case_id", pattern_type="CASE WHEN size > 4 THEN 'Layering' ELSE 'mixed' END", coverage_tier="'tier0'"), D(confidence="risk"), tail="FROM kase", **HIGH))
def vie7(spark, d):
    return views.case_explanations(typed_cases(spark, d)).select("case_id", "pattern_type", "coverage_tier", "confidence")


# ---- reports -------------------------------------------------------------------------------------------------


@query("rep1", select(I(total_files="1", total_transactions="(SELECT count(*) FROM rows_s)", suspicious_transactions="(SELECT count(*) FROM sus)", cluster_count="(SELECT count(*) FROM clus)",
                        high="count(*) FILTER (risk_level = 'high')", medium="count(*) FILTER (risk_level = 'medium')", medium_low="count(*) FILTER (risk_level = 'medium-low')", low="count(*) FILTER (risk_level = 'low')"),
                      D(threshold_used="0.75"), tail="FROM rows_s", **V))
def rep1(spark, d):
    v = Derived(spark, d)
    return reports.summary_row(v.scores, v.suspicious, v.clusters)


@query("rep1_findings", select(S(cluster_id="cluster_id", label="'Cluster (' || wallet_count || ' wallets)'", typology="typology", risk_level="risk_level"),
                               I(wallet_count="wallet_count", tx_count="tx_count"), D(risk_score="risk_score", total_amount="total_amount"), tail="FROM clus JOIN amounts USING (cluster_id)", **V))
def rep1_findings(spark, d):
    return reports.cluster_findings(Derived(spark, d).clusters).drop("level_rank")


def report_parts(spark, d):
    v = Derived(spark, d)
    s = v.suspicious.withColumns({c: F.lit(0.0) for c in ("behavioral_score", "graph_score", "entity_score", "temporal_score", "offramp_score")})
    return reports.summary_row(v.scores, v.suspicious, v.clusters), reports.top_suspicious(s), reports.cluster_findings(v.clusters)


@query("snk5")
def snk5(spark, d):
    """The run document written as JSON and read back."""
    from ..sources.store import write_documents
    from .q_clean import scratch

    path = scratch(spark, "document")
    write_documents(reports.run_document("derived", *report_parts(spark, d)), path)
    return spark.read.json(path).groupBy("run_id").agg(F.max(F.size("top_suspicious_transactions")).alias("n_top"), F.count("cluster_finding").alias("n_findings"))


@query("rep2")
def rep2(spark, d):
    """Run summary in bullet lines of at most a hundred words."""
    return reports.run_summary(*report_parts(spark, d))


@query("rep3", select(S(case_id="case_id", primary_wallet="primary_wallet"), I(n_wallets="wallet_count"), D(total_amount="amount", risk_score="risk"), tail="FROM kase", **HIGH))
def rep3(spark, d):
    """Case report with the high-risk wallets of each case."""
    from ..operators.selection import high_risk_wallets

    lg = build_graph(cell_transfers(spark, d))
    comps = cut_lineage(connected_components(lg.edges, lg.nodes))
    marked = high_risk_wallets(scored(spark, d))
    r = reports.case_report(cl.case_facts(lg.edges, comps, marked), cl.cluster_members(comps, marked, 3))
    return r.select("case_id", "primary_wallet", "n_wallets", "total_amount", "risk_score")


@query("rep4", select(S(case_id="'run-derived'", typology="(SELECT typology FROM clus ORDER BY risk_score DESC, cluster_id LIMIT 1)", primary_wallet="(SELECT min(wallet) FROM ends)"),
                      I(n_suspicious="count(*)", n_clusters="(SELECT count(*) FROM clus)", wallet_count="(SELECT count(DISTINCT wallet) FROM ends)"), T(start_time="min(timestamp)", end_time="max(timestamp)"),
                      D(total_amount="(SELECT sum(total_amount) FROM amounts)", risk_score="(SELECT max(risk_score) FROM clus)"), tail="FROM sus", ends=f"SELECT * FROM {ENDS}", **V))
def rep4(spark, d):
    """Filing record of the derived run."""
    v = Derived(spark, d)
    r = filing.run_record("derived", v.suspicious, v.clusters, v.members)
    return r.select("case_id", "typology", "primary_wallet", "n_suspicious", "n_clusters", "wallet_count", "start_time", "end_time", "total_amount", "risk_score")


def filings(spark, d):
    lg = build_graph(cell_transfers(spark, d))
    first = connected_components(lg.edges, lg.nodes).groupBy(F.col("component").alias("case_id")).agg(F.min("wallet").alias("primary_wallet"))
    return filing.filing_rows(typed_cases(spark, d).join(first, "case_id"))


@query("rep5", select(S(case_id="case_id", identification="case_id", subject_name="'Wallet ' || left(case_id, 8) || '...'", types="CASE WHEN size > 4 THEN 'Money Laundering,Structuring' ELSE 'Money Laundering' END"),
                      T(activity_date_from="lo", activity_date_to="hi"), D(total_amount="amount"), tail="FROM kase", **HIGH))
def rep5(spark, d):
    """Subject and activity columns of every case filing."""
    f = filings(spark, d)
    return f.select("case_id", "identification", "subject_name", F.array_join("activity_types", ",").alias("types"), "activity_date_from", "activity_date_to", "total_amount")


@query("rep6", sql("""SELECT cluster_id, section, value FROM (SELECT cluster_id, 'method' AS section, asset_type AS value FROM sus UNION SELECT cluster_id, 'origin', sender_wallet FROM sus
UNION SELECT cluster_id, 'destination', receiver_wallet FROM sus UNION SELECT cluster_id, 'chain', chain_id FROM sus)""", **V))
def rep6(spark, d):
    """Distinct layout values per cluster."""
    return filing.layout_values(Derived(spark, d).suspicious, "cluster_id")


@query("rep7", select(S(case_id="case_id", valid="NOT (n % 5 = 0 OR n % 7 = 0 OR n % 3 = 0)", errors="""concat_ws('|', CASE WHEN n % 5 = 0 THEN 'tax number is not two digits, a hyphen and seven digits' END,
  CASE WHEN n % 7 = 0 THEN 'amount is not above zero' END, CASE WHEN n % 3 = 0 THEN 'last day of activity lies before the first' END)"""),
                      tail="FROM (SELECT *, CAST(floor(amount) AS BIGINT) AS n FROM kase)", **HIGH))
def rep7(spark, d):
    """Filings damaged by rule: bad tax id, non-positive amount, reversed dates."""
    f = filings(spark, d)
    n = F.floor("total_amount")
    f = f.withColumns({
        "tin": F.when(n % 5 == 0, "1234").otherwise("12-3456789"), "activity_date_to": F.when(n % 3 == 0, F.col("activity_date_from") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("activity_date_to")),
        "total_amount": F.when(n % 7 == 0, 0.0).otherwise(F.col("total_amount")),
    })
    return filing.check_filing(f).select("case_id", "valid", F.array_join("errors", "|").alias("errors"))


@query("wallet_levels", sql(f"SELECT sender_wallet AS wallet, CAST(max({RANK.format(x='risk_level')}) AS BIGINT) AS rank FROM {SC} GROUP BY 1"))
def wallet_levels(spark, d):
    """The most severe level per sender."""
    return scored(spark, d).groupBy(F.col("sender_wallet").alias("wallet")).agg(F.max(level_rank(F.col("risk_level"))).alias("rank"))


