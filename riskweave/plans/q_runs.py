"""Queries over scoring runs: fusion, selection, clusters, typology, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings, Thresholds
from ..functions.risk import level_from_score
from ..operators import clusters as cl
from ..operators import drift, evaluate as ev, fusion, reports, typology as ty
from ..operators import graph as g
from ..operators.components import connected_components
from ..operators.rules.catalogue import RULE_TABLE
from ..operators.selection import high_risk_wallets, suspicious, touched_wallets
from ..operators.tx_features import send_history
from ..operators.training import time_split
from ..session import cut_lineage
from ..sources.adapter import cell_transfers, transfers
from .catalog import query
from .q_joins import SC, scored
from .q_graph import RANK_BASE, RANK_STEPS
from .q_rules import FROM_SUPPLIED, MULE, SUPPLIED, TAG_HITS, TAGGED, TAGS, latest, supplied, tag_table
from .q_windows import CURVE, SCORED, scored_labels
from .scoring import build_graph, cluster_tables, entity_fallback, run_pipeline, score_transfers, wallet_rules
from .sql import D, I, S, T, select, sql


def score_run(t):
    """Scores of the no-model path with components as communities and global metrics off."""
    gr = build_graph(t)
    none = gr.nodes.select("wallet", F.lit(0.0).alias("suspicious_neighbor_ratio_1hop"))
    rules = wallet_rules(t, gr, none, latest(t))
    comps = cut_lineage(connected_components(gr.edges, gr.nodes))
    part = comps.withColumnRenamed("component", "community")
    return cut_lineage(score_transfers(t, rules, None, entity_fallback(gr, part))), gr, comps


def run_l(spark, d):
    return score_run(cell_transfers(spark, d))


@query("flagship", select(S(transaction_id="transaction_id", sender_wallet="sender_wallet", receiver_wallet="receiver_wallet", risk_level="risk_level", top_rule="top_name"),
                          D(amount="amount", meta_score="meta_score", top_confidence="top_conf"), I(rules_fired="fired"), tail="FROM su_a"))
def flagship(spark, d):
    """Suspicious transfers with meta score, tier and strongest rule."""
    s, _, _ = score_run(transfers(spark, d))
    return s.where(suspicious()).select(
        "transaction_id", "sender_wallet", "receiver_wallet", "risk_level", F.col("heuristic_top_typology").alias("top_rule"), "amount", "meta_score",
        F.col("heuristic_top_confidence").alias("top_confidence"), F.col("heuristic_triggered_count").alias("rules_fired"),
    )


_NAMES = {row[0]: row[1] for row in RULE_TABLE}
_RANKED = "SELECT wallet, r FROM rank_steps WHERE k = (SELECT min(k) FROM (SELECT k, sum(d) s FROM rank_steps WHERE k > 0 GROUP BY k) WHERE s < (SELECT count(*) FROM nd_a) * 1e-6)"
# confidences of the rules that need tags, a caller's table or risky neighbours, over one row per wallet
_MORE = {**FROM_SUPPLIED, **TAGGED, 144: "CASE WHEN taint > 0.5 THEN least(taint, 1) ELSE 0 END",
         179: "CASE WHEN ransomware THEN greatest(0.8, least(taint, 1)) ELSE 0 END",
         185: f"CASE WHEN {MULE} THEN least(least(total_out / total_in, 1) + CASE WHEN coalesce(risky, false) THEN 0.2 ELSE 0 END, 1) ELSE 0 END"}
FULL = {
    "tags": TAGS, "tag_hits": TAG_HITS, "sup": SUPPLIED, "rank_base": RANK_BASE, "rank_steps": RANK_STEPS,
    "taints": f"""SELECT b.wallet, count(k.wallet) / count(*) AS share FROM nb_a b LEFT JOIN (SELECT wallet FROM ({_RANKED}) WHERE r > 1.5 / (SELECT count(*) FROM nd_a)) k ON k.wallet = b.nb GROUP BY 1""",
    "wide": """SELECT p.*, s.* EXCLUDE (wallet), h.* EXCLUDE (wallet), st.relay_pattern_score, st.unique_counterparties,
  coalesce(t.share, 0) * CASE WHEN coalesce(h.exchange, false) THEN 2 ELSE 1 END AS taint FROM pf_a p LEFT JOIN sup s USING (wallet)
  LEFT JOIN tag_hits h USING (wallet) LEFT JOIN taints t USING (wallet) LEFT JOIN st_a st USING (wallet)""",
    "every": "SELECT * FROM rl_a WHERE id <> 185 UNION ALL " + " UNION ALL ".join(
        f"SELECT wallet, {i} AS id, '{_NAMES[i]}' AS name, c AS conf FROM (SELECT wallet, CAST(coalesce({e}, 0) AS DOUBLE) AS c FROM (SELECT * FROM wide p)) WHERE c > 0".replace("p.in_degree", "in_degree")
        for i, e in _MORE.items()),
    "per": """SELECT wallet, count(*) AS fired, max(conf) AS top_conf, avg(conf) AS mean_conf, string_agg(id, ',' ORDER BY id) AS ids,
  arg_min(name, (-conf, id)) AS top_name FROM every GROUP BY 1""",
    "full_s": """SELECT *, CASE WHEN meta_score >= 0.9 THEN 'high' WHEN meta_score >= 0.75 THEN 'medium' WHEN meta_score <= 0.3 THEN 'low' ELSE 'medium-low' END AS risk_level
FROM (SELECT t.*, coalesce(r.fired, 0) AS fired, r.top_name, r.top_conf, coalesce(r.mean_conf, 0) AS mean_conf, coalesce(r.ids, '') AS ids,
  least(greatest(CAST(0.125 AS DOUBLE) * coalesce(e.entity_score, 0) + CAST(0.175 AS DOUBLE) * coalesce(r.top_conf, 0), 0), 1) AS meta_score
FROM tx_a t LEFT JOIN per r ON r.wallet = t.sender_wallet LEFT JOIN en_a e ON e.wallet = t.sender_wallet)""",
}


def full_run(spark, d, communities):
    """The run with PageRank shares, tags, a caller's wallet table and communities."""
    t = transfers(spark, d)
    n = g.nodes_of(g.wallet_edges(t)).count()
    settings = Settings(risky_pagerank=1.5 / n)  # in an even graph of this size nobody reaches a hundredth
    return run_pipeline(t, settings, latest(t), communities=communities, enrichment=supplied(t), tags=tag_table(t))


@query("run_full", select(S(transaction_id="transaction_id", risk_level="risk_level", coverage_tier="'tier1'", ids="ids", top_rule="top_name"), I(rules_fired="fired"),
                          D(meta_score="meta_score", heuristic_mean="mean_conf", has_address_tags="1"), tail="FROM full_s", **FULL))
def run_full(spark, d):
    """Score rows of the whole run with components as communities."""
    return full_run(spark, d, "components").scores.select(
        "transaction_id", "risk_level", "coverage_tier", F.coalesce(F.array_join("triggered_ids", ","), F.lit("")).alias("ids"), F.col("heuristic_top_typology").alias("top_rule"),
        F.coalesce("heuristic_triggered_count", F.lit(0)).alias("rules_fired"), "meta_score", "heuristic_mean", "has_address_tags")


@query("run_louvain")
def run_louvain(spark, d):
    """Clusters of the whole run with communities by local moves."""
    return full_run(spark, d, "louvain").clusters


@query("len4", select(S(wallet="wallet"), D(entity_score="entity_score"), tail="FROM en_l"))
def len4(spark, d):
    """Entity score without a classifier, components as communities."""
    lg = build_graph(cell_transfers(spark, d))
    part = connected_components(lg.edges, lg.nodes).withColumnRenamed("component", "community")
    return entity_fallback(lg, part).select("wallet", "entity_score")


@query("met1", select(S(transaction_id="transaction_id"), I(heuristic_triggered_count="fired"), D(heuristic_mean="mean_conf", heuristic_max="coalesce(top_conf, 0)", heuristic_triggered_ratio="fired / 185",
       entity_score="entity_score", behavioral_score="0", coverage_tier_0="1", coverage_tier_1="0", has_address_tags="0", n_lenses_available="0"), tail="FROM sc_l"))
def met1(spark, d):
    """The meta feature columns of the no-model path."""
    s, _, _ = run_l(spark, d)
    return s.select("transaction_id", F.coalesce("heuristic_triggered_count", F.lit(0)).alias("heuristic_triggered_count"), F.coalesce("heuristic_mean", F.lit(0.0)).alias("heuristic_mean"),
                    F.coalesce("heuristic_max", F.lit(0.0)).alias("heuristic_max"), F.coalesce("heuristic_triggered_ratio", F.lit(0.0)).alias("heuristic_triggered_ratio"),
                    "entity_score", "behavioral_score", "coverage_tier_0", "coverage_tier_1", "has_address_tags", "n_lenses_available")


@query("met2", select(S(transaction_id="transaction_id"), D(meta_score="""least(greatest(0.225 * (ord % 10 / 10.0) + 0.175 * (ord % 9 / 9.0) + 0.125 * (ord % 8 / 8.0)
  + 0.175 * (ord % 7 / 7.0) + 0.125 * (ord % 6 / 6.0) + 0.175 * (ord % 5 / 5.0), 0), 1)"""), tail="FROM tx_a"))
def met2(spark, d):
    """Fusion weights over six derived scores."""
    o = F.col("ord")
    names = ["behavioral_score", "graph_score", "entity_score", "temporal_score", "offramp_score", "heuristic_max"]
    cols = {n: o % k / float(k) for n, k in zip(names, (10, 9, 8, 7, 6, 5))}
    return transfers(spark, d).select("transaction_id", fusion.weighted_score(cols).alias("meta_score"))


MET4 = """SELECT p AS t, tp / predicted AS pr, tp / total AS re FROM (SELECT threshold AS p, * FROM curve)"""


@query("met4", select(D(decision_threshold="t", precision_at_threshold="pr", recall_at_threshold="re", f1_at_threshold="2 * pr * re / (pr + re + 1e-8)",
                        high_risk_threshold="least(t * 1.5, 0.95)", low_risk_ceiling="greatest(t * 0.5, 0.1)"), tail="FROM (SELECT * FROM pts WHERE re >= 0.95 ORDER BY pr DESC, t LIMIT 1)",
                      curve=CURVE, pts=MET4))
def met4(spark, d):
    return fusion.choose_threshold(fusion.precision_recall_points(scored_labels(spark, d), "y", "p"))


@query("met5", sql(f"SELECT risk_level, count(*) AS n, CAST(0.75 AS DOUBLE) AS decision_threshold FROM {SC} GROUP BY 1"))
def met5(spark, d):
    """Default thresholds applied to derived scores."""
    out = scored(spark, d).groupBy(level_from_score(F.col("meta_score"), DEFAULTS.thresholds).alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("decision_threshold", F.lit(DEFAULTS.thresholds.decision))


@query("met6", select(S(transaction_id="transaction_id", risk_level="risk_level", meta_provenance="'fallback'", coverage_tier="'tier0'", ids="coalesce(ids, '')", top_rule="top_name"),
                      I(rules_fired="fired"), D(meta_score="meta_score", entity_score="entity_score", decision_threshold="0.75"), tail="FROM sc_l"))
def met6(spark, d):
    """Result rows of the cell run."""
    s, _, _ = run_l(spark, d)
    return s.select("transaction_id", "risk_level", "meta_provenance", "coverage_tier", F.coalesce(F.array_join("triggered_ids", ","), F.lit("")).alias("ids"),
                    F.col("heuristic_top_typology").alias("top_rule"), F.coalesce("heuristic_triggered_count", F.lit(0)).alias("rules_fired"), "meta_score", "entity_score", "decision_threshold")


@query("met7", sql(f"""SELECT transaction_id, CASE WHEN a IS NOT NULL AND meta_score >= least(a + 0.3, 0.99) THEN 'case' WHEN meta_score >= a THEN 'alert' ELSE 'none' END AS action
FROM {SC} LEFT JOIN (SELECT asset_type AS k, avg(fee) / 10 AS a FROM tx_a WHERE asset_type <> 'view' GROUP BY 1) ON k = asset_type"""))
def met7(spark, d):
    """Cohort thresholds by asset type; one cohort has no policy."""
    p = transfers(spark, d).where(F.col("asset_type") != "view").groupBy(F.col("asset_type").alias("cohort_key")).agg((F.avg("fee") / 10).alias("alert_threshold"))
    p = p.withColumn("case_threshold", F.least(F.col("alert_threshold") + 0.3, F.lit(0.99)))
    return fusion.apply_policies(scored(spark, d), p, "asset_type").select("transaction_id", "action")


@query("sel1", select(S(transaction_id="transaction_id"), tail=f"""FROM (SELECT *, ord % 4 AS n, ord % 13 / 50.0 AS c FROM {SC})
WHERE meta_score >= 0.75 OR risk_level <> 'low' OR label = 'illicit' OR (n > 0 AND c >= 0.15)"""))
def sel1(spark, d):
    """Suspicious set over derived scores so that every clause decides some rows."""
    s = scored(spark, d).withColumns({"heuristic_triggered_count": F.col("ord") % 4, "heuristic_top_confidence": F.col("ord") % 13 / 50.0})
    return s.where(suspicious()).select("transaction_id")


@query("agg12", sql(f"SELECT count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'medium-low') AS medium_low, count(*) FILTER (risk_level = 'low') AS low FROM {SC}"))
def agg12(spark, d):
    return reports.score_distribution(scored(spark, d))


# ---- clusters ------------------------------------------------------------------------------------------------

CL = {
    "marked": "SELECT sender_wallet AS wallet FROM su_l UNION SELECT receiver_wallet FROM su_l",
    "mem": "SELECT component AS cluster_id, wallet FROM cc_l WHERE wallet IN (SELECT wallet FROM marked) QUALIFY count(*) OVER (PARTITION BY component) >= 2",
    "touch": "SELECT t.*, coalesce(s.cluster_id, r.cluster_id) AS cluster_id FROM sc_l t LEFT JOIN mem s ON s.wallet = sender_wallet LEFT JOIN mem r ON r.wallet = receiver_wallet WHERE coalesce(s.cluster_id, r.cluster_id) IS NOT NULL",
    "facts": """SELECT m.cluster_id, m.n AS wallet_count, z.n AS component_size, m.n / z.n AS density_risk, coalesce(e.a, 0) AS total_amount, coalesce(e.k, 0) AS tx_count, coalesce(r.m, m.n / z.n) AS risk_score
FROM (SELECT cluster_id, count(*) n FROM mem GROUP BY 1) m JOIN (SELECT component, count(*) n FROM cc_l GROUP BY 1) z ON z.component = m.cluster_id
LEFT JOIN (SELECT s.cluster_id, sum(amount) a, count(*) k FROM ed_l JOIN mem s ON s.wallet = src JOIN mem t ON t.wallet = dst AND t.cluster_id = s.cluster_id GROUP BY 1) e USING (cluster_id)
LEFT JOIN (SELECT cluster_id, avg(meta_score) m FROM touch GROUP BY 1) r USING (cluster_id)""",
}


def cluster_run(spark, d):
    """Scores, suspicious rows, clusters and typologies of the cell run."""
    s, gr, _ = run_l(spark, d)
    return cluster_tables(s, s.where(suspicious()), gr)


def cluster_parts(spark, d):
    s, gr, comps = run_l(spark, d)
    return s, gr, comps, cut_lineage(cl.cluster_members(comps, touched_wallets(s.where(suspicious()))))


@query("clu1", sql("SELECT cluster_id, wallet FROM mem", **CL))
def clu1(spark, d):
    return cluster_parts(spark, d)[3]


@query("clu2", select(S(cluster_id="cluster_id", label="'Cluster (' || wallet_count || ' wallets)'"), I(wallet_count="wallet_count", component_size="component_size", tx_count="tx_count"),
                      D(density_risk="density_risk", total_amount="total_amount", risk_score="risk_score + 1e-9"), tail="FROM facts", **CL))
def clu2(spark, d):
    """Cluster facts. A mean that ends in half of the last compared decimal, give or take the order of its sum, is rounded up."""
    s, gr, comps, mem = cluster_parts(spark, d)
    return cl.cluster_facts(gr.edges, s, mem, comps).withColumn("risk_score", F.col("risk_score") + 1e-9)


@query("clu3", sql("SELECT transaction_id, cluster_id FROM su_l LEFT JOIN (SELECT transaction_id, cluster_id FROM touch) USING (transaction_id)", **CL))
def clu3(spark, d):
    s, _, _, mem = cluster_parts(spark, d)
    return cl.assign_clusters(s.where(suspicious()), mem).select("transaction_id", "cluster_id")


HIGH = f"SELECT sender_wallet AS wallet FROM {SC} WHERE meta_score >= 0.75 UNION SELECT receiver_wallet FROM {SC} WHERE meta_score >= 0.75"


@query("clu4", select(S(case_id="c.component", case_name="'Suspicious Network (' || c.n || ' wallets)'"), I(wallet_count="c.n", component_size="z.n"), T(start_time="e.lo", end_time="e.hi"),
                      D(risk_score="c.n / z.n", total_amount="e.a"), tail="""FROM (SELECT component, count(*) n FROM cc_l WHERE wallet IN (SELECT wallet FROM high) GROUP BY 1 HAVING count(*) >= 3) c
JOIN (SELECT component, count(*) n FROM cc_l GROUP BY 1) z USING (component) LEFT JOIN (SELECT component, sum(amount) a, min(timestamp) lo, max(timestamp) hi FROM ed_l JOIN cc_l ON wallet = src GROUP BY 1) e USING (component)""", high=HIGH))
def clu4(spark, d):
    """Cases around high-risk wallets in the cell graph."""
    return cases(spark, d).drop("explanation")


def cases(spark, d):
    lg = build_graph(cell_transfers(spark, d))
    comps = cut_lineage(connected_components(lg.edges, lg.nodes))
    return cl.case_facts(lg.edges, comps, high_risk_wallets(scored(spark, d)))


@query("gra21", select(S(wallet="wallet", suspicious="bool_or(sus)", risk_level="arg_max(risk_level, (meta_score, -ord))"), D(meta_score="max(meta_score)"), tail=f"""
FROM (SELECT sender_wallet AS wallet, * FROM (SELECT *, meta_score >= 0.75 AS sus FROM {SC}) UNION ALL SELECT receiver_wallet, * FROM (SELECT *, meta_score >= 0.75 AS sus FROM {SC})) GROUP BY 1"""))
def gra21(spark, d):
    s = scored(spark, d)
    return cl.wallet_notes(s, s.where(F.col("meta_score") >= 0.75))


# ---- typology ------------------------------------------------------------------------------------------------

HINTS = "CASE asset_type WHEN 'view' THEN 'Peel  pattern' WHEN 'click' THEN 'Fan Out burst' WHEN 'purchase' THEN 'round trip' WHEN 'signup' THEN 'layer 2' END"
TY = {
    "ctx": f"SELECT t.*, c.component AS cluster_id, {HINTS} AS hint FROM sc_l t JOIN cc_l c ON c.wallet = t.sender_wallet",
    "truth": """SELECT cluster_id, arg_min(lab, (-n, lab)) AS truth FROM (SELECT cluster_id, CASE hint WHEN 'Peel  pattern' THEN 'peel chain' WHEN 'Fan Out burst' THEN 'fan-out'
  WHEN 'round trip' THEN 'circular loop / round-tripping' WHEN 'layer 2' THEN 'layering' END AS lab, count(*) n FROM ctx WHERE hint IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "votes": """SELECT cluster_id, arg_min(lab, (-w, lab)) AS vote FROM (SELECT cluster_id, lab, round(sum(greatest(0.05, coalesce(top_conf, 0))), 9) AS w FROM (
  SELECT *, CASE top_name WHEN 'PeelChain' THEN 'peel chain' WHEN 'FanOutDispersal' THEN 'fan-out' WHEN 'FanInAggregation' THEN 'many-to-one collection'
  WHEN 'ConsolidationAfterObfuscation' THEN 'reconsolidation' WHEN 'CrossWalletChainLoops' THEN 'cross-chain bridge hop' WHEN 'LayeredHopsFreshWallets' THEN 'layering' END AS lab FROM ctx)
  WHERE lab IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "deg": "SELECT c.component AS cluster_id, m.* FROM cc_l c JOIN nm_l m USING (wallet)",
    "merge_hint": """SELECT cluster_id, bool_or(k >= 2) AS merges FROM (SELECT d.cluster_id, e.dst, count(*) k FROM ed_l e JOIN deg d ON d.wallet = e.src WHERE d.out_degree >= 2 GROUP BY 1, 2) GROUP BY 1""",
    "cyc8": """SELECT src AS root, [src, dst] AS path, dst AS last, false AS closed FROM ed_l WHERE dst > src
UNION ALL SELECT w.root, CASE WHEN e.dst = w.root THEN w.path ELSE list_append(w.path, e.dst) END, e.dst, e.dst = w.root FROM cyc8 w JOIN ed_l e ON e.src = w.last
WHERE NOT w.closed AND (e.dst = w.root OR (e.dst > w.root AND NOT list_contains(w.path, e.dst) AND len(w.path) < 8))""",
    "shape": """SELECT cluster_id, CASE WHEN mo >= thr THEN 'fan-out' WHEN mi >= thr THEN 'many-to-one collection' WHEN coalesce(merges, false) THEN 'reconsolidation'
  WHEN cluster_id IN (SELECT component FROM cyc8 JOIN cc_l ON wallet = root WHERE closed) THEN 'circular loop / round-tripping'
  WHEN ds / n < 2.5 THEN 'peel chain' ELSE 'layering' END AS structure
FROM (SELECT cluster_id, count(*) n, max(out_degree) mo, max(in_degree) mi, sum(in_degree + out_degree) ds, greatest(3, least(10, 2 + count(*) // 3)) AS thr FROM deg GROUP BY 1) LEFT JOIN merge_hint USING (cluster_id)""",
    "strong": "SELECT cluster_id, median(ord * 37 % 1000 / 1000.0::DOUBLE) AS med FROM ctx GROUP BY 1",
}


def component_rows(spark, d):
    """Cell transfers with their component as cluster, ground-truth hint and derived off-ramp score."""
    s, gr, comps = run_l(spark, d)
    mem = comps.select("wallet", F.col("component").alias("cluster_id"))
    rows = s.join(mem.withColumnRenamed("wallet", "sender_wallet"), "sender_wallet")
    a = F.col("asset_type")
    hint = F.when(a == "view", "Peel  pattern").when(a == "click", "Fan Out burst").when(a == "purchase", "round trip").when(a == "signup", "layer 2")
    return rows.withColumns({"aml_pattern": hint, "offramp_score": F.col("ord") * 37 % 1000 / 1000.0}), gr, mem


@query("typ1", sql("SELECT cluster_id, truth FROM truth", **TY))
def typ1(spark, d):
    return ty.truth_mode(component_rows(spark, d)[0])


@query("typ2", sql("SELECT cluster_id, count(DISTINCT chain_id) >= 2 AS cross_chain FROM ctx GROUP BY 1", **TY))
def typ2(spark, d):
    return ty.cross_chain(component_rows(spark, d)[0])


@query("typ3", sql("SELECT cluster_id, vote FROM votes", **TY))
def typ3(spark, d):
    return ty.rule_vote(component_rows(spark, d)[0])


@query("typ4", select(S(cluster_id="cluster_id", offramp_strong="med >= 0.42"), D(median_offramp="med"), tail="FROM strong", **TY))
def typ4(spark, d):
    return ty.strong_offramp(component_rows(spark, d)[0])


def structure_inputs(spark, d):
    lg = build_graph(cell_transfers(spark, d))
    mem = connected_components(lg.edges, lg.nodes).select("wallet", F.col("component").alias("cluster_id"))
    return cl.cluster_edges(lg.edges, mem), cl.member_degrees(lg.edges, mem)


@query("typ5", sql("SELECT cluster_id, structure FROM shape", **TY))
def typ5(spark, d):
    inner, deg = structure_inputs(spark, d)
    return ty.structure_typology(cut_lineage(inner), cut_lineage(deg))


@query("typ6", sql("SELECT cluster_id, merges FROM merge_hint", **TY))
def typ6(spark, d):
    return ty.merge_hint(*structure_inputs(spark, d))


@query("typ7", sql("""SELECT cluster_id, CASE WHEN cluster_id > 'w3' AND truth IS NOT NULL THEN truth WHEN cross_chain THEN 'cross-chain bridge hop'
  WHEN med >= 0.42 AND base IN ('layering', 'peel chain') THEN 'offramp exits' ELSE base END AS typology
FROM (SELECT *, CASE WHEN vote = 'peel chain' AND structure IN ('fan-out', 'many-to-one collection', 'circular loop / round-tripping', 'reconsolidation') THEN structure
  WHEN vote IS NOT NULL AND vote <> 'layering' THEN vote ELSE structure END AS base
FROM shape LEFT JOIN truth USING (cluster_id) LEFT JOIN votes USING (cluster_id) LEFT JOIN strong USING (cluster_id)
LEFT JOIN (SELECT cluster_id, count(DISTINCT chain_id) >= 2 AS cross_chain FROM ctx GROUP BY 1) USING (cluster_id))""", **TY))
def typ7(spark, d):
    """Final typology; clusters named up to 'w3' have no ground truth, so the later clauses decide."""
    rows, gr, mem = component_rows(spark, d)
    rows = rows.withColumn("aml_pattern", F.when(F.col("cluster_id") > "w3", F.col("aml_pattern")))
    inner, deg = cut_lineage(cl.cluster_edges(gr.edges, mem)), cut_lineage(cl.member_degrees(gr.edges, mem))
    return ty.cluster_typology(inner, deg, cut_lineage(rows)).select("cluster_id", "typology")


# ---- evaluation and drift ------------------------------------------------------------------------------------

CM = f"""SELECT count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn,
  count(*) FILTER (y = 0 AND p < 0.5)::DOUBLE AS tn, avg((p - y) * (p - y)) AS brier FROM {SCORED}"""


@query("eva1", select(I(tp="tp", fp="fp", fn="fn", tn="tn"), D(precision="tp / (tp + fp)", recall="tp / (tp + fn)", f1="2 * tp / (2 * tp + fp + fn)", balanced_accuracy="(tp / (tp + fn) + tn / (tn + fp)) / 2",
                      mcc="(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))", brier_score="brier"), tail="FROM cm", cm=CM))
def eva1(spark, d):
    s = scored_labels(spark, d).withColumn("hat", (F.col("p") >= 0.5).cast("int"))
    return ev.classification(s, "y", "hat", "p")


ROC = f"""SELECT sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS roc FROM {SCORED} a JOIN {SCORED} b ON a.y = 1 AND b.y = 0"""


@query("eva2", select(D(pr_auc="sum(pos * tp / predicted) / any_value(total)", roc_auc="(SELECT roc FROM roc_pairs)"), tail="FROM curve", curve=CURVE, roc_pairs=ROC))
def eva2(spark, d):
    return ev.ranking_areas(scored_labels(spark, d), "y", "p")


KS = ", ".join(f"avg(y) FILTER (r <= {k}) AS pk{k}, sum(y) FILTER (r <= {k}) / sum(y) AS rk{k}" for k in (50, 100, 200, 500))


@query("eva3", select(D(**{f"precision_at_{k}": f"pk{k}" for k in (50, 100, 200, 500)}, **{f"recall_at_{k}": f"rk{k}" for k in (50, 100, 200, 500)}),
                      tail=f"FROM (SELECT {KS} FROM (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id DESC) r FROM {SCORED}))"))
def eva3(spark, d):
    return ev.ranking_at_k(scored_labels(spark, d), "y", "p", "doc_id")


@query("eva4", sql(f"SELECT count(*) AS points, round(min(tp / predicted), 6) + 0.0 AS lowest FROM ({CURVE})"))
def eva4(spark, d):
    pts = fusion.precision_recall_points(scored_labels(spark, d), "y", "p")
    return pts.agg(F.count(F.lit(1)).alias("points"), F.min("precision").alias("lowest"))


BIN = " + ".join(f"(p >= {i} * 0.1::DOUBLE)::INT" for i in range(1, 10))


@query("eva5", select(D(ece="sum(n * abs(acc - conf)) / sum(n)"), tail=f"FROM (SELECT {BIN} AS b, count(*) n, avg(y) acc, avg(p) conf FROM {SCORED} GROUP BY 1)"))
def eva5(spark, d):
    return ev.calibration_error(scored_labels(spark, d), "y", "p")


def class_sql(c: int) -> str:
    v = SCORED if c else f"(SELECT doc_id, 1 - y AS y, 1 - p AS p FROM {SCORED})"
    return f"""SELECT {c} AS class, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS support,
(SELECT sum(pos * tp / predicted) / any_value(total) FROM (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) tp, sum(cnt) OVER (ORDER BY p DESC) predicted, sum(pos) OVER () total
  FROM (SELECT p, sum(y) pos, count(*) cnt FROM {v} GROUP BY 1))) AS pr_auc
FROM (SELECT count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE tp, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE fp, count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE fn FROM {v})"""


@query("eva6", select(I(**{"class": "class", "support": "support"}), D(precision="precision", recall="recall", f1="f1", pr_auc="pr_auc"), tail=f"FROM ({class_sql(1)} UNION ALL {class_sql(0)})"))
def eva6(spark, d):
    return ev.per_class(scored_labels(spark, d), "y", "p")


@query("eva7", sql("SELECT count(DISTINCT sender_wallet) AS first_rows, CAST(0 AS BIGINT) AS bad_deviation, CAST(0 AS BIGINT) AS bad_gap FROM tx_a"))
def eva7(spark, d):
    """First transfers of a sender carry no history."""
    from ..operators.ordered import ordered_scan

    f = ordered_scan(send_history(transfers(spark, d)), ["sender_wallet"], ["timestamp", "ord"], index="_i")
    return drift.leakage(f.withColumn("is_first_send", F.col("_i") == 1))


@query("eva7_split", sql("SELECT CAST(0 AS BIGINT) AS shared_keys, count(*) AS keys FROM tx_a"))
def eva7_split(spark, d):
    """No transfer occurs in two parts of a time split."""
    s = time_split(transfers(spark, d), ["timestamp", "ord"], {"train": 0.6, "val": 0.2, "test": 0.2})
    return drift.split_overlap(s, "transaction_id")


PSI = """SELECT feature, sum((c / tc + 1e-6 - (r / tr + 1e-6)) * ln((c / tc + 1e-6) / (r / tr + 1e-6))) AS psi FROM (
SELECT g.feature, g.b, coalesce(sum((side = 0)::INT), 0)::DOUBLE AS r, coalesce(sum((side = 1)::INT), 0)::DOUBLE AS c,
  sum(coalesce(sum((side = 0)::INT), 0)) OVER (PARTITION BY g.feature)::DOUBLE AS tr, sum(coalesce(sum((side = 1)::INT), 0)) OVER (PARTITION BY g.feature)::DOUBLE AS tc
FROM (SELECT feature, unnest(range(10)) AS b FROM (VALUES ('amount'), ('fee')) v(feature)) g
LEFT JOIN (SELECT v.feature, v.side, CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS b FROM vals v
  JOIN (SELECT feature, min(x) lo, max(x) hi FROM vals WHERE side = 0 GROUP BY 1) s ON s.feature = v.feature AND x BETWEEN lo AND hi) q ON q.feature = g.feature AND q.b = g.b
GROUP BY 1, 2) GROUP BY 1"""
VALS = """SELECT 'amount' AS feature, (timestamp >= TIMESTAMP '2024-01-16')::INT AS side, CASE WHEN timestamp >= TIMESTAMP '2024-01-16' THEN amount * 1.5 ELSE amount END AS x FROM tx_a
UNION ALL SELECT 'fee', (timestamp >= TIMESTAMP '2024-01-16')::INT, fee FROM tx_a"""


@query("eva8", select(S(feature="feature", drifted="psi > 0.1"), D(psi="psi"), tail="FROM psi", vals=VALS, psi=PSI))
def eva8(spark, d):
    """Second half of the month, with amounts raised by half, against the first."""
    t = transfers(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    ref, cur = t.where(F.col("timestamp") < cut), t.where(F.col("timestamp") >= cut)
    return drift.feature_psi(ref, cur.withColumn("amount", F.col("amount") * 1.5), ["amount", "fee"])


@query("eva9", select(D(reference_rate="r", current_rate="c", rate_shift="abs(c - r)"), S(drifted="abs(c - r) > 0.1"), tail="""
FROM (SELECT avg((label = 'illicit')::INT) FILTER (timestamp < TIMESTAMP '2024-01-16') AS r, avg((label = 'illicit')::INT) FILTER (timestamp >= TIMESTAMP '2024-01-16') AS c FROM tx_a WHERE label IS NOT NULL)"""))
def eva9(spark, d):
    t = transfers(spark, d).where(F.col("label").isNotNull()).withColumn("y", (F.col("label") == "illicit").cast("int"))
    cut = F.lit("2024-01-16").cast("timestamp")
    return drift.label_drift(t.where(F.col("timestamp") < cut), t.where(F.col("timestamp") >= cut), "y")


WIDE = f"""SELECT chain_id AS cohort_key, date_trunc('day', timestamp) AS w, count(*) FILTER (label = 'illicit' AND meta_score >= 0.5)::DOUBLE AS tp,
  count(*) FILTER (label = 'licit' AND meta_score >= 0.5)::DOUBLE AS fp, count(*) FILTER (label = 'illicit' AND meta_score < 0.5)::DOUBLE AS fn,
  avg(pow(meta_score - (label = 'illicit')::INT, 2)) AS brier, count(*)::DOUBLE AS n FROM {SC} WHERE label IS NOT NULL GROUP BY 1, 2"""
LONG = """SELECT cohort_key, w, 'precision' AS metric_name, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS v FROM wide
UNION ALL SELECT cohort_key, w, 'recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END FROM wide
UNION ALL SELECT cohort_key, w, 'brier_score', brier FROM wide UNION ALL SELECT cohort_key, w, 'row_count', n FROM wide"""
EVA10 = (S(model_name="'derived'", cohort_key="cohort_key", metric_name="metric_name"), D(metric_value="v"), T(window_start="w", window_end="w + INTERVAL 1 DAY"))


def metric_table(spark, d):
    s = scored(spark, d).where(F.col("label").isNotNull()).withColumns({"y": (F.col("label") == "illicit").cast("int"), "hat": (F.col("meta_score") >= 0.5).cast("int")})
    return ev.metric_rows(s, "derived", "chain_id", "timestamp", "y", "hat", "meta_score")


@query("eva10", select(*EVA10, tail="FROM long_rows", wide=WIDE, long_rows=LONG))
def eva10(spark, d):
    return metric_table(spark, d)


@query("fil4", select(*EVA10, tail="FROM long_rows WHERE metric_name = 'recall' OR metric_name LIKE 'br%'", wide=WIDE, long_rows=LONG))
def fil4(spark, d):
    """Metric rows by exact name and by name prefix."""
    m = metric_table(spark, d)
    return ev.metrics_named(m, "recall").unionByName(ev.metrics_named(m, prefix="br"))


@query("thresholds_high", sql("SELECT count(*) AS n FROM sc_l WHERE meta_score >= 0.15"))
def thresholds_high(spark, d):
    """A run with its own thresholds."""
    s, _, _ = run_l(spark, d)
    custom = Settings(thresholds=Thresholds(0.15, 0.2, 0.05))
    return s.where(level_from_score(F.col("meta_score"), custom.thresholds).isin("high", "medium")).agg(F.count(F.lit(1)).alias("n"))


