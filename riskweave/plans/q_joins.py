"""Queries over joins and filters on stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filing, graph as g, paging, training
from ..operators.selection import high_risk_wallets, touched_wallets
from ..operators.tx_features import transaction_features
from ..operators.window24 import window_features
from ..session import cut_lineage
from ..sources import transfers as src
from ..sources.adapter import cell_transfers, large_transfers, table, transfers
from .catalog import query
from .q_scalars import LEVEL, SCORE, derived_score
from .scoring import build_graph, combined_features, node_features
from .sql import D, I, S, T, select, sql


def scored(spark, d):
    """Transfers with a derived score and level."""
    from ..functions.risk import level_from_score

    t = cell_transfers(spark, d).withColumn("meta_score", derived_score())
    return t.withColumn("risk_level", level_from_score(F.col("meta_score")))


def scores(spark, d):
    return scored(spark, d).select("transaction_id", "meta_score", "risk_level")


SC = f"(SELECT *, {SCORE} AS meta_score, {LEVEL.format(s=SCORE)} AS risk_level FROM tx_l)"


VELOCITY = "SELECT wallet, (sum(sent) + sum(received)) / (epoch(max(timestamp) - min(timestamp)) + 1.0) AS v FROM ro_w GROUP BY 1"
ENTROPY = "SELECT src AS wallet, sum(-p * ln(p + 1e-12)) AS h FROM (SELECT src, amount / sum(amount) OVER (PARTITION BY src) AS p FROM ed_w WHERE amount > 0) GROUP BY 1"


def combined(spark, d):
    """Node and window features on both ends of every transfer."""
    t = transfers(spark, d)
    return combined_features(t, node_features(build_graph(t), "none"), cut_lineage(window_features(t)))


@query("joi1", select(S(transaction_id="transaction_id"), I(sender_graph_in_degree="coalesce(s.in_degree, 0)", receiver_graph_out_degree="coalesce(r.out_degree, 0)", in_degree="coalesce(s.in_degree, 0)"),
                      D(sender_graph_balance_ratio="coalesce(s.balance_ratio, 0)", receiver_graph_relay_pattern_score="coalesce(r.relay_pattern_score, 0)", fan_in_ratio="coalesce(s.fan_in_ratio, 0)", sender_sub_velocity_score="coalesce(v.v, 0)"),
                      tail="FROM tx_a LEFT JOIN st_a s ON s.wallet = sender_wallet LEFT JOIN st_a r ON r.wallet = receiver_wallet LEFT JOIN vel v ON v.wallet = sender_wallet", vel=VELOCITY))
def joi1(spark, d):
    """Node features on both ends, beside a window feature."""
    return combined(spark, d).select("transaction_id", "sender_graph_in_degree", "receiver_graph_out_degree", "in_degree", "sender_graph_balance_ratio", "receiver_graph_relay_pattern_score", "fan_in_ratio", "sender_sub_velocity_score")


@query("joi2", select(S(transaction_id="transaction_id"), D(sender_sub_velocity_score="coalesce(s.v, 0)", receiver_sub_velocity_score="coalesce(r.v, 0)", sender_sub_fund_splitting_entropy="coalesce(a.h, 0)", receiver_sub_fund_splitting_entropy="coalesce(b.h, 0)"), tail="""FROM tx_a
LEFT JOIN vel s ON s.wallet = sender_wallet LEFT JOIN vel r ON r.wallet = receiver_wallet LEFT JOIN ent a ON a.wallet = sender_wallet LEFT JOIN ent b ON b.wallet = receiver_wallet""", vel=VELOCITY, ent=ENTROPY))
def joi2(spark, d):
    """Window features on both ends; wallets outside the window get 0."""
    return combined(spark, d).select("transaction_id", *[f"{side}_sub_{c}" for c in ("velocity_score", "fund_splitting_entropy") for side in ("sender", "receiver")])


@query("features_all")
def features_all(spark, d):
    """Transaction, graph and window features combined."""
    from .scoring import feature_tables

    return feature_tables(transfers(spark, d), mode="none")["combined"].drop("timestamp")


FIL3 = select(S(transaction_id="transaction_id"), D(meta_score="meta_score"), tail=f"FROM {SC} WHERE label = 'illicit' AND meta_score >= 0.6")


@query("fil3", FIL3)
def fil3(spark, d):
    return paging.filtered(transfers(spark, d), scores(spark, d), "illicit", 0.6).select("transaction_id", "meta_score")


@query("joi3", select(S(transaction_id="transaction_id"), D(meta_score="meta_score", amount="amount"), tail=f"FROM {SC} WHERE meta_score >= 0.9"))
def joi3(spark, d):
    return paging.filtered(transfers(spark, d), scores(spark, d), None, 0.9).select("transaction_id", "meta_score", "amount")


@query("joi5", select(S(wallet="w.wallet"), D(total_out="w.total_out", score="s.m"), tail=f"""FROM pf_l w LEFT JOIN (
SELECT sender_wallet, max(meta_score) m FROM {SC} GROUP BY 1) s ON s.sender_wallet = w.wallet"""))
def joi5(spark, d):
    """Wallets with their stored score where there is one."""
    w = g.wallet_totals(cell_transfers(spark, d))
    s = scored(spark, d).groupBy(F.col("sender_wallet").alias("wallet")).agg(F.max("meta_score").alias("score"))
    return w.join(s, "wallet", "left").select("wallet", "total_out", "score")


@query("joi6", select(S(transaction_id="transaction_id"), D(meta_score="meta_score"), tail=f"FROM {SC} WHERE transaction_id IN (SELECT transaction_id FROM tx_h)"))
def joi6(spark, d):
    """Batch score lookup for a set of ids."""
    return scores(spark, d).join(large_transfers(spark, d).select("transaction_id"), "transaction_id", "left_semi").select("transaction_id", "meta_score")


@query("joi8", sql("SELECT x.src AS w, count(DISTINCT p.dst) AS shared_children FROM ed_l x JOIN ed_l y ON y.src = x.src AND y.dst <> x.dst JOIN ed_l p ON p.src = x.dst JOIN ed_l q ON q.src = y.dst AND q.dst = p.dst GROUP BY 1"))
def joi8(spark, d):
    """Targets reached through two different successors."""
    e = g.wallet_edges(cell_transfers(spark, d)).select("src", "dst")
    two = e.toDF("w", "a").join(e.toDF("a", "c"), "a").groupBy("w", "c").agg(F.count(F.lit(1)).alias("k"))
    return two.where(F.col("k") >= 2).groupBy("w").agg(F.count(F.lit(1)).alias("shared_children"))


BAD = "(SELECT DISTINCT sender_wallet AS w FROM tx_a WHERE label = 'illicit')"


def labelled_wallets(spark, d):
    return transfers(spark, d).where(F.col("label") == "illicit").select(F.col("sender_wallet").alias("node_id"), "label")


@query("joi10", select(S(src="src", dst="dst", label=f"CASE WHEN src IN (SELECT w FROM {BAD}) OR dst IN (SELECT w FROM {BAD}) THEN 'illicit' ELSE 'licit' END"), tail="FROM ed_a"))
def joi10(spark, d):
    return src.edge_labels(g.wallet_edges(transfers(spark, d)).select("src", "dst"), labelled_wallets(spark, d))


@query("joi11", select(S(case_id="c.component", wallet="c.wallet"), I(wallets="k.n"), tail="FROM cc_l c JOIN (SELECT component, count(*) n FROM cc_l GROUP BY 1 HAVING count(*) >= 3) k USING (component)"))
def joi11(spark, d):
    """Cases with their wallets, one row per wallet."""
    from ..operators.components import connected_components

    lg = build_graph(cell_transfers(spark, d))
    c = connected_components(lg.edges, lg.nodes)
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("wallets")).where(F.col("wallets") >= 3)
    return n.join(c, "component").select(F.col("component").alias("case_id"), "wallet", "wallets")


REPR = """SELECT 'rep_' || n.wallet AS transaction_id, CASE WHEN o.v IS NOT NULL THEN n.wallet ELSE i.v END AS sender_wallet,
  CASE WHEN o.v IS NOT NULL THEN o.v ELSE n.wallet END AS receiver_wallet, n.label, n.amount
FROM (SELECT sender_wallet AS wallet, max(CASE WHEN label = 'illicit' THEN 1 ELSE 0 END) AS label, max(amount) AS amount FROM tx_l WHERE label IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'lonely_' || n_name, 0, 1.0 FROM nation) n
LEFT JOIN (SELECT src, min(dst) v FROM ed_l GROUP BY 1) o ON o.src = n.wallet LEFT JOIN (SELECT dst, min(src) v FROM ed_l GROUP BY 1) i ON i.dst = n.wallet
WHERE o.v IS NOT NULL OR i.v IS NOT NULL"""


def labelled_nodes(spark, d):
    t = cell_transfers(spark, d).where(F.col("label").isNotNull())
    return t.groupBy(F.col("sender_wallet").alias("node_id")).agg(
        F.when(F.max((F.col("label") == "illicit").cast("int")) == 1, "illicit").otherwise("licit").alias("label"),
        F.max("amount").alias("amount"), F.max("timestamp").alias("timestamp"),
    )


@query("joi13", select(S(transaction_id="transaction_id", sender_wallet="sender_wallet", receiver_wallet="receiver_wallet"), I(label="label"), D(amount="greatest(amount, 1e-8)"), tail="FROM repr", repr=REPR))
def joi13(spark, d):
    """One representative edge per labelled wallet."""
    e = g.wallet_edges(cell_transfers(spark, d)).select("src", "dst")
    return src.representative_edges(labelled_nodes(spark, d), e).select("transaction_id", "sender_wallet", "receiver_wallet", "label", "amount")


@query("joi14", sql("SELECT p_brand AS cluster_id, count(*) AS report_parts, any_value(live.n) AS live_lines FROM part LEFT JOIN (SELECT p_brand b, count(*) n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) live ON live.b = p_brand GROUP BY 1"))
def joi14(spark, d):
    """Reported groups next to their live rows by id."""
    p = table(spark, d, "part")
    report = p.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("report_parts"))
    live = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return report.join(live.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("live_lines")), "cluster_id", "left")


LARGE_WALLETS = "(SELECT sender_wallet FROM tx_h WHERE sender_wallet <> receiver_wallet UNION SELECT receiver_wallet FROM tx_h WHERE sender_wallet <> receiver_wallet)"


@query("fil6", sql(f"""SELECT 'edges' AS part, count(*) AS n FROM ed_a WHERE src IN {LARGE_WALLETS} AND dst IN {LARGE_WALLETS}
UNION ALL SELECT 'features', count(*) FROM tx_a WHERE sender_wallet IN {LARGE_WALLETS}
UNION ALL SELECT 'labels', count(DISTINCT sender_wallet) FROM tx_a WHERE label IS NOT NULL AND sender_wallet IN {LARGE_WALLETS}"""))
def fil6(spark, d):
    """Edges, features and labels restricted to the wallets of large transfers."""
    t = transfers(spark, d)
    keep = g.nodes_of(g.wallet_edges(large_transfers(spark, d)))
    labels = t.where(F.col("label").isNotNull()).select(F.col("sender_wallet").alias("wallet")).distinct()
    parts = training.subset(g.wallet_edges(t), t, labels, keep)
    return src.union_in_order([df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, df in parts.items()])


@query("set2", sql(f"SELECT component, count(*) AS hits FROM cc_l WHERE wallet IN (SELECT sender_wallet FROM {SC} WHERE meta_score >= 0.75 UNION SELECT receiver_wallet FROM {SC} WHERE meta_score >= 0.75) GROUP BY 1"))
def set2(spark, d):
    """Component wallets that are also high-risk wallets."""
    from ..operators.components import connected_components

    lg = build_graph(cell_transfers(spark, d))
    hit = connected_components(lg.edges, lg.nodes).join(high_risk_wallets(scored(spark, d)), "wallet", "left_semi")
    return hit.groupBy("component").agg(F.count(F.lit(1)).alias("hits"))


@query("sel2", sql("SELECT sender_wallet AS wallet FROM tx_l UNION SELECT receiver_wallet FROM tx_l"))
def sel2(spark, d):
    return touched_wallets(cell_transfers(spark, d))


@query("sel3", sql(f"SELECT sender_wallet AS wallet FROM {SC} WHERE meta_score >= 0.995 UNION SELECT receiver_wallet FROM {SC} WHERE meta_score >= 0.995"))
def sel3(spark, d):
    return high_risk_wallets(scored(spark, d), 0.995)


@query("fil5", select(S(record_id="transaction_id", status="CASE WHEN ord % 3 = 0 THEN 'filed' ELSE status END", filed="ord % 3 = 0"), T(created_at="timestamp"), tail="""
FROM (SELECT *, 'draft' AS status FROM tx_l) WHERE CASE WHEN ord % 3 = 0 THEN 'filed' ELSE status END = 'filed' ORDER BY timestamp DESC, ord LIMIT 20"""))
def fil5(spark, d):
    """Draft records of which every third is filed; the newest filed ones are listed."""
    rec = cell_transfers(spark, d).select(F.col("transaction_id").alias("record_id"), F.lit("draft").alias("status"), F.col("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("filing_date"), "ord")
    new = filing.set_status(rec, F.col("ord") % 3 == 0, "filed")
    out = filing.by_status(new, "filed", 20)
    return out.select("record_id", "status", F.col("filing_date").isNotNull().alias("filed"), "created_at")


@query("trn_features", select(S(transaction_id="transaction_id"), I(label="label"), D(amount="greatest(amount, 1e-8)"), tail="FROM repr", repr=REPR))
def trn_features(spark, d):
    """Per-transfer features of the representative training rows."""
    e = g.wallet_edges(cell_transfers(spark, d)).select("src", "dst")
    rows = src.representative_edges(labelled_nodes(spark, d), e)
    f = transaction_features(rows.withColumns({"fee": F.lit(None).cast("double"), "ord": F.xxhash64("transaction_id")}))
    return f.select("transaction_id", "label", "amount")
