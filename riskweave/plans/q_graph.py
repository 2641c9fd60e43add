"""Queries over the wallet graph: aggregates, multi-hop and iterative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import graph as g
from ..operators import khop
from ..operators.betweenness import betweenness
from ..operators.communities import leiden, louvain, partition_checks
from ..operators.components import connected_components
from ..operators.cycles import clustering, cycles_per_wallet, ego_cycles, simple_cycles
from ..operators.cleaning import trailing_hours
from ..operators.pagerank import pagerank
from ..operators.window24 import active_wallets, longest_hops, reconvergence, splitting, velocity, window_features
from ..session import cut_lineage
from ..sources.adapter import cell_transfers, table, transfers
from .catalog import query
from .scoring import build_graph, global_metrics
from .sql import D, I, S, T, select, sql


def edges_of(spark, d):
    return g.wallet_edges(transfers(spark, d))


def large_graph(spark, d):
    return build_graph(cell_transfers(spark, d))


def communities(spark, d):
    """Components of the cell graph as a fixed partition."""
    lg = large_graph(spark, d)
    return lg, connected_components(lg.edges, lg.nodes).withColumnRenamed("component", "community")


@query("agg1", select(S(src="src", dst="dst", transaction_id="transaction_id", asset_type="asset_type"), D(amount="amount"), I(n_tx="n_tx"), T(timestamp="timestamp"), tail="FROM ed_a"))
def agg1(spark, d):
    return edges_of(spark, d)


@query("agg2", sql("SELECT wallet FROM nd_a"))
def agg2(spark, d):
    return g.nodes_of(edges_of(spark, d))


@query("agg3", select(S(id="v.id", label="t.label"), D(amount="t.amount"), I(links="coalesce(k.n, 0)"), tail="""
FROM (SELECT transaction_id AS id FROM tx_a) v JOIN tx_a t ON t.transaction_id = v.id
LEFT JOIN (SELECT src, count(*) n FROM (SELECT DISTINCT transaction_id AS src, concat('tx_', (ord * 3) % (SELECT count(*) FROM tx_a)) AS dst FROM tx_a) GROUP BY 1) k ON k.src = v.id"""))
def agg3(spark, d):
    """Transfers linked by a rule over their ids, every link listed twice; the repeat collapses."""
    t = transfers(spark, d)
    n = t.agg(F.count(F.lit(1))).scalar()
    links = t.select(F.col("transaction_id").alias("src"), F.concat(F.lit("tx_"), ((F.col("ord") * 3) % n).cast("string")).alias("dst"), "ord")
    gr = g.transaction_graph(t, links.unionByName(links))
    k = gr["edges"].groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return gr["vertices"].join(k, "id", "left").na.fill({"links": 0})


@query("agg4", select(S(wallet="wallet"), I(in_degree="in_degree", out_degree="out_degree"),
                      D(weighted_in="weighted_in", weighted_out="weighted_out", total_volume="total_volume", balance_ratio="balance_ratio"), tail="FROM nm_a"))
def agg4(spark, d):
    return g.node_metrics(edges_of(spark, d))


@query("agg5", select(S(wallet="wallet"), T(first_seen="min(timestamp)", last_seen="max(timestamp)"), D(total_in="sum(received)", total_out="sum(sent)"), tail="FROM ro_a GROUP BY wallet"))
def agg5(spark, d):
    return g.wallet_totals(transfers(spark, d))


@query("agg6", select(S(wallet="wallet", in_graph="in_graph"), T(first_seen="first_seen", last_seen="last_seen"),
                      I(tx_count="tx_count", n_below_10000="n_below_10000", n_below_3000="n_below_3000", n_round_100="n_round_100", in_degree="in_degree", out_degree="out_degree"),
                      D(total_in="total_in", total_out="total_out", avg_amount="avg_amount", pass_through="pass_through", balance="balance"), tail="FROM pf_a"))
def agg6(spark, d):
    t = transfers(spark, d)
    return g.wallet_profiles(t, g.node_metrics(g.wallet_edges(t)))


@query("agg7", select(S(wallet="dst", deposit_from="src"), tail="FROM ed_a"))
def agg7(spark, d):
    return g.inbound_counterparties(edges_of(spark, d))


@query("agg8", select(S(wallet="wallet"), I(unique_counterparties="unique_counterparties"), D(fan_in_ratio="fan_in_ratio", fan_out_ratio="fan_out_ratio"), tail="FROM st_a"))
def agg8(spark, d):
    gr = build_graph(transfers(spark, d))
    return g.structural_features(gr.metrics, gr.neighbours).select("wallet", "unique_counterparties", "fan_in_ratio", "fan_out_ratio")


@query("agg11", select(S(wallet="wallet"), D(relay_pattern_score="relay_pattern_score"), tail="FROM st_a"))
def agg11(spark, d):
    gr = build_graph(transfers(spark, d))
    return g.structural_features(gr.metrics, gr.neighbours).select("wallet", "relay_pattern_score")


# a wallet counts as risky here when its volume is above a fixed line, so the shares have exact SQL
RISKY = "(SELECT wallet AS risky FROM nm_a WHERE total_volume > 150000)"


def volume_risky(spark, d):
    gr = build_graph(transfers(spark, d))
    return gr, gr.metrics.where(F.col("total_volume") > 150000).select(F.col("wallet").alias("risky"))


@query("agg9", select(S(wallet="n.wallet"), D(ratio="count(r.risky) / count(*)"), tail=f"FROM nb_a n LEFT JOIN {RISKY} r ON r.risky = n.nb GROUP BY 1"))
def agg9(spark, d):
    gr, risky = volume_risky(spark, d)
    return g.risky_direct_share(gr.neighbours, risky).select("wallet", F.col("suspicious_neighbor_ratio_1hop").alias("ratio"))


@query("agg10", select(S(wallet="p.wallet"), D(ratio="count(r.risky) / count(*)"), tail=f"""
FROM (SELECT DISTINCT x.wallet, y.nb FROM nb_a x JOIN nb_a y ON y.wallet = x.nb WHERE y.nb <> x.wallet) p LEFT JOIN {RISKY} r ON r.risky = p.nb GROUP BY 1"""))
def agg10(spark, d):
    gr, risky = volume_risky(spark, d)
    return g.risky_neighbour_shares(gr.neighbours, risky).select("wallet", F.col("suspicious_neighbor_ratio_2hop").alias("ratio"))


@query("agg10_hubs", sql("""SELECT wallet, count(*) AS n2 FROM (SELECT DISTINCT x.wallet, y.nb FROM nb_a x JOIN nb_a y ON y.wallet = x.nb
WHERE y.nb <> x.wallet) GROUP BY 1"""))
def agg10_hubs(spark, d):
    """Two-hop counts on the path that keeps hubs out of the pair expansion."""
    gr = build_graph(transfers(spark, d))
    return g.two_hop_counts(gr.neighbours, gr.nodes, hub_degree=28)


RANK_BASE = """SELECT n.wallet, count(e.src) AS o, 1.0::DOUBLE / (SELECT count(*) FROM nd_a) AS base
FROM nd_a n LEFT JOIN ed_a e ON e.src = n.wallet GROUP BY 1"""
RANK_STEPS = """SELECT wallet, o, base, base AS r, 0.0::DOUBLE AS d, 0 AS k FROM rank_base
UNION ALL
SELECT n.wallet, n.o, n.base, v.r, abs(v.r - n.r), n.k + 1 FROM rank_steps n
JOIN (SELECT p.wallet, 0.15 * any_value(p.base) + 0.85 * coalesce(sum(q.r / q.o), 0) + 0.85 * any_value(p.base) * any_value(z.dang) AS r
      FROM rank_steps p LEFT JOIN ed_a e ON e.dst = p.wallet LEFT JOIN rank_steps q ON q.wallet = e.src
      CROSS JOIN (SELECT coalesce(sum(CASE WHEN o = 0 THEN r END), 0) AS dang FROM rank_steps) z GROUP BY p.wallet) v ON v.wallet = n.wallet
WHERE n.k < 40"""
RANK_PICK = """wallet, round(r, 6) + 0.0 AS pagerank FROM rank_steps
WHERE k = (SELECT min(k) FROM (SELECT k, sum(d) s FROM rank_steps WHERE k > 0 GROUP BY k) WHERE s < (SELECT count(*) FROM nd_a) * 1e-6)"""


@query("gra1", sql(f"SELECT {RANK_PICK}", rank_base=RANK_BASE, rank_steps=RANK_STEPS))
def gra1(spark, d):
    gr = build_graph(transfers(spark, d))
    return pagerank(gr.edges, gr.nodes)


# Distances and numbers of shortest paths in the cell graph; no component of it has paths of twenty links.
PATHS = {
    "found": "SELECT wallet AS s, wallet AS v, 0 AS d FROM nd_l UNION SELECT f.s, e.dst, f.d + 1 FROM found f JOIN ed_l e ON e.src = f.v WHERE f.d < 20",
    "far": "SELECT s, v, min(d) AS d FROM found GROUP BY 1, 2",
    "ways": """SELECT wallet AS s, wallet AS v, 0 AS d, 1.0::DOUBLE AS n FROM nd_l UNION ALL
SELECT w.s, e.dst, w.d + 1, sum(w.n) FROM ways w JOIN ed_l e ON e.src = w.v JOIN far ON far.s = w.s AND far.v = e.dst AND far.d = w.d + 1 GROUP BY 1, 2, 3""",
    "mid": """SELECT a.v AS wallet, sum(a.n * b.n / c.n) AS x FROM ways a JOIN ways b ON b.s = a.v JOIN ways c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d
WHERE a.d > 0 AND b.d > 0 GROUP BY 1""",
}
BETWEEN = "(SELECT n.wallet, coalesce(x, 0) / (((SELECT count(*) FROM nd_l) - 1.0) * ((SELECT count(*) FROM nd_l) - 2.0)) AS b FROM nd_l n LEFT JOIN mid USING (wallet))"


@query("gra2", select(S(wallet="wallet"), D(betweenness="b"), tail=f"FROM {BETWEEN}", **PATHS))
def gra2(spark, d):
    """Exact betweenness of the cell graph."""
    lg = large_graph(spark, d)
    return betweenness(lg.edges, lg.nodes)


@query("gra2_batches", select(S(wallet="wallet"), D(betweenness="b"), tail=f"FROM {BETWEEN}", **PATHS))
def gra2_batches(spark, d):
    """The same by joins over all components, with sources taken in batches of about a third."""
    lg, part = communities(spark, d)
    size = part.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    rows = int(size.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)
    return betweenness(lg.edges, lg.nodes, most_rows=max(rows // 3, 1), most_steps=0)


@query("gra3", select(S(wallet="n.wallet"), D(clustering_coefficient="CASE WHEN x.d > 1 THEN coalesce(t.t, 0) / (x.d * (x.d - 1)) ELSE 0 END"), tail="""
FROM nd_a n JOIN (SELECT wallet, count(*) d FROM nb_a GROUP BY 1) x USING (wallet)
LEFT JOIN (SELECT p.wallet, count(*) t FROM nb_a p JOIN nb_a q ON q.wallet = p.nb JOIN nb_a r ON r.wallet = p.wallet AND r.nb = q.nb GROUP BY 1) t USING (wallet)"""))
def gra3(spark, d):
    gr = build_graph(transfers(spark, d))
    return clustering(gr.edges, gr.nodes)


COEFFICIENT = """(SELECT n.wallet, CASE WHEN x.d > 1 THEN coalesce(t.t, 0) / (x.d * (x.d - 1)) ELSE 0 END AS c FROM nd_{s} n JOIN (SELECT wallet, count(*) d FROM nb_{s} GROUP BY 1) x USING (wallet)
LEFT JOIN (SELECT p.wallet, count(*) t FROM nb_{s} p JOIN nb_{s} q ON q.wallet = p.nb JOIN nb_{s} r ON r.wallet = p.wallet AND r.nb = q.nb GROUP BY 1) t USING (wallet))"""


@query("gra4", select(S(wallet="wallet"), D(pagerank="pagerank", betweenness="0", clustering_coefficient="c"), tail=f"FROM (SELECT {RANK_PICK}) JOIN {COEFFICIENT.format(s='a')} USING (wallet)",
                      rank_base=RANK_BASE, rank_steps=RANK_STEPS))
def gra4(spark, d):
    """The global metrics whose cost grows in line with the links; betweenness is 0."""
    return global_metrics(build_graph(transfers(spark, d)), "linear")


@query("gra4_full", select(S(wallet="wallet"), D(pagerank="pagerank", betweenness="b", clustering_coefficient="c"), tail=f"FROM (SELECT {RANK_PICK.replace('nd_a', 'nd_l')}) JOIN {BETWEEN} USING (wallet) JOIN {COEFFICIENT.format(s='l')} USING (wallet)",
                           rank_base=RANK_BASE.replace("_a", "_l"), rank_steps=RANK_STEPS.replace("ed_a", "ed_l"), **PATHS))
def gra4_full(spark, d):
    """All global metrics, on the cell graph."""
    return global_metrics(large_graph(spark, d), "full")


@query("gra4_none", select(S(wallet="wallet"), D(pagerank="0", betweenness="0", clustering_coefficient="0"), tail="FROM nd_a"))
def gra4_none(spark, d):
    """The metrics switched off."""
    return global_metrics(build_graph(transfers(spark, d)), "none")


def cycle_walk(s: str) -> str:
    """Recursive enumeration of simple cycles from their smallest wallet."""
    return f"""SELECT src AS root, [src, dst] AS path, dst AS last, false AS closed FROM ed_{s} WHERE dst > src
UNION ALL SELECT w.root, CASE WHEN e.dst = w.root THEN w.path ELSE list_append(w.path, e.dst) END, e.dst, e.dst = w.root
FROM walk w JOIN ed_{s} e ON e.src = w.last
WHERE NOT w.closed AND (e.dst = w.root OR (e.dst > w.root AND NOT list_contains(w.path, e.dst) AND len(w.path) < 10))"""


@query("gra5", sql("SELECT array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS length FROM walk WHERE closed", walk=cycle_walk("l")))
def gra5(spark, d):
    """Simple cycles of up to ten wallets in the cell graph."""
    return simple_cycles(g.wallet_edges(cell_transfers(spark, d)), 10).select(F.array_join("path", ">").alias("path"), "length")


@query("gra5a", select(S(wallet="wallet"), I(n3="c2 + c3", n4="c2 + c3 + c4", n5="c2 + c3 + c4 + c5", n6="c2 + c3 + c4 + c5 + c6"), tail="FROM cy_a"))
def gra5a(spark, d):
    n = ego_cycles(edges_of(spark, d))
    return n.select("wallet", "n3", "n4", "n5", "n6")


@query("gra5b", sql("SELECT wallet, count(*) AS circularity_score FROM (SELECT unnest(path) AS wallet FROM walk WHERE closed) GROUP BY 1", walk=cycle_walk("l")))
def gra5b(spark, d):
    """Cycles of the cell graph each wallet lies on."""
    return cycles_per_wallet(simple_cycles(g.wallet_edges(cell_transfers(spark, d)), 10))


def reconvergence_sql(s: str) -> str:
    return select(S(wallet="k.src"), D(reconvergence_score="CASE WHEN k.k > 1 THEN coalesce(s.p, 0) / (k.k * (k.k - 1) / 2) ELSE 0 END"), tail=f"""
FROM (SELECT src, count(*) k FROM ed_{s} GROUP BY 1) k LEFT JOIN (SELECT w, count(*) p FROM (
  SELECT DISTINCT x.src AS w, x.dst AS a, y.dst AS b FROM ed_{s} x JOIN ed_{s} y ON y.src = x.src AND y.dst > x.dst
  JOIN ed_{s} p ON p.src = x.dst JOIN ed_{s} q ON q.src = y.dst AND q.dst = p.dst) GROUP BY 1) s ON s.w = k.src""")


@query("gra6", reconvergence_sql("a"))
def gra6(spark, d):
    return reconvergence(cut_lineage(edges_of(spark, d)))


@query("gra6_hubs", reconvergence_sql("a"))
def gra6_hubs(spark, d):
    """The same shares on the path that treats busy wallets as hubs."""
    return reconvergence(cut_lineage(edges_of(spark, d)), hub_degree=10)


CHAIN = """SELECT sender_wallet AS wallet, receiver_wallet AS at, timestamp AS t, ord AS o, 1 AS hops FROM tx_w
UNION SELECT c.wallet, x.receiver_wallet, x.timestamp, x.ord, c.hops + 1 FROM chain c JOIN tx_w x ON x.sender_wallet = c.at
WHERE x.timestamp > c.t OR (x.timestamp = c.t AND x.ord > c.o)"""


@query("gra7", sql("SELECT wallet, CAST(max(hops) AS BIGINT) AS hop_count_in_window FROM chain GROUP BY 1", chain=CHAIN))
def gra7(spark, d):
    return longest_hops(trailing_hours(transfers(spark, d)))


@query("gra8", select(S(wallet="src"), D(fund_splitting_entropy="sum(-p * ln(p + 1e-12))", fragmentation_score="CASE WHEN count(*) > 1 THEN sum(-p * ln(p + 1e-12)) / (ln(count(*)) + 1e-12) ELSE 0 END"),
                      tail="FROM (SELECT src, amount / sum(amount) OVER (PARTITION BY src) AS p FROM ed_w WHERE amount > 0) GROUP BY 1"))
def gra8(spark, d):
    return splitting(g.wallet_edges(trailing_hours(transfers(spark, d))))


@query("gra9", select(S(wallet="wallet"), D(velocity_score="(sum(sent) + sum(received)) / (epoch(max(timestamp) - min(timestamp)) + 1.0)"), tail="FROM ro_w GROUP BY 1"))
def gra9(spark, d):
    return velocity(trailing_hours(transfers(spark, d)))


def busiest(edges):
    """The wallet with the largest number of edges, ties to the smallest name."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("wallet")).groupBy("wallet").agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.col("n").desc(), "wallet").limit(1).select("wallet")


HOPS = {
    "seed": """SELECT wallet FROM (SELECT src AS wallet FROM ed_l UNION ALL SELECT dst FROM ed_l) GROUP BY 1 ORDER BY count(*) DESC, wallet LIMIT 1""",
    "grown": "SELECT wallet, 0 AS hop FROM seed UNION SELECT n.nb, g.hop + 1 FROM grown g JOIN nb_l n USING (wallet) WHERE g.hop < 3",
    "near": "SELECT wallet, min(hop) AS hop FROM grown GROUP BY 1",
}


@query("gra11", sql("SELECT wallet, CAST(hop AS BIGINT) AS hop FROM near", **HOPS))
def gra11(spark, d):
    """Wallets within three steps of the busiest wallet of the cell graph."""
    e = cut_lineage(g.wallet_edges(cell_transfers(spark, d)))
    return khop.k_hop_nodes(e, busiest(e), 3)


@query("gra11_edges", sql("SELECT src, dst FROM ed_l WHERE src IN (SELECT wallet FROM near) AND dst IN (SELECT wallet FROM near)", **HOPS))
def gra11_edges(spark, d):
    e = cut_lineage(g.wallet_edges(cell_transfers(spark, d)))
    return khop.k_hop_subgraph(e, busiest(e), 3)["edges"].select("src", "dst")


@query("gra12", sql("""SELECT src, dst FROM ed_a WHERE
src IN (SELECT sender_wallet FROM tx_a WHERE label = 'illicit' AND amount > 30000 UNION SELECT nb FROM nb_a WHERE wallet IN (SELECT sender_wallet FROM tx_a WHERE label = 'illicit' AND amount > 30000))
AND dst IN (SELECT sender_wallet FROM tx_a WHERE label = 'illicit' AND amount > 30000 UNION SELECT nb FROM nb_a WHERE wallet IN (SELECT sender_wallet FROM tx_a WHERE label = 'illicit' AND amount > 30000))"""))
def gra12(spark, d):
    """One-step graph around the senders of large illicit transfers."""
    t = transfers(spark, d)
    seeds = t.where((F.col("label") == "illicit") & (F.col("amount") > 30000)).select(F.col("sender_wallet").alias("wallet")).distinct()
    return khop.k_hop_subgraph(cut_lineage(g.wallet_edges(t)), seeds, 1)["edges"].select("src", "dst")


@query("gra13")
def gra13(spark, d):
    """Bounded sample grown from label-stratified seeds."""
    t = transfers(spark, d)
    labels = t.where(F.col("label").isNotNull()).groupBy(F.col("sender_wallet").alias("wallet")).agg(F.min("label").alias("label"))
    return khop.bounded_sample(cut_lineage(g.wallet_edges(t)), labels, 200, 2, 5)


@query("gra14", sql("SELECT wallet, component FROM cc_l"))
def gra14(spark, d):
    lg = large_graph(spark, d)
    return connected_components(lg.edges, lg.nodes)


@query("gra14_full", sql("SELECT component, count(*) AS wallets FROM cc_a GROUP BY 1"))
def gra14_full(spark, d):
    gr = build_graph(transfers(spark, d))
    return connected_components(gr.edges, gr.nodes).groupBy("component").agg(F.count(F.lit(1)).alias("wallets"))


@query("gra15")
def gra15(spark, d):
    lg = large_graph(spark, d)
    return louvain(lg.edges, lg.nodes)


@query("gra16")
def gra16(spark, d):
    lg = large_graph(spark, d)
    return leiden(lg.edges, lg.nodes)


CHECKS = sql("SELECT (SELECT count(*) FROM nd_l) AS wallets, true AS above_components, true AS connected, 0 AS gaining")


@query("gra15_checks", CHECKS)
def gra15_checks(spark, d):
    """What a partition must fulfil: all wallets, modularity of the components at least, connected parts, no gain by a single move."""
    lg = large_graph(spark, d)
    return partition_checks(lg.edges, lg.nodes, louvain(lg.edges, lg.nodes))


@query("gra16_checks", CHECKS)
def gra16_checks(spark, d):
    """The same for parts refined before contraction."""
    lg = large_graph(spark, d)
    return partition_checks(lg.edges, lg.nodes, leiden(lg.edges, lg.nodes))


@query("gra16_giant", sql("SELECT (SELECT count(*) FROM nd_a) AS wallets, true AS above_components, true AS connected, 0 AS gaining"))
def gra16_giant(spark, d):
    """The checks on the graph of all wallets, whose one component is treated as too large for a task."""
    gr = build_graph(transfers(spark, d))
    return partition_checks(gr.edges, gr.nodes, leiden(gr.edges, gr.nodes, most=1000))


@query("gra17", select(S(cluster_id="c.component"), I(size="count(*)", internal_edges="any_value(coalesce(e.k, 0))"),
                       D(mean_risk="avg(abs(m.balance_ratio))", max_risk="max(abs(m.balance_ratio))", density="CASE WHEN count(*) > 1 THEN any_value(coalesce(e.k, 0)) / (count(*) * (count(*) - 1)) ELSE 0 END"),
                       tail="FROM cc_l c JOIN nm_l m USING (wallet) LEFT JOIN (SELECT component, count(*) k FROM ed_l JOIN cc_l ON wallet = src GROUP BY 1) e USING (component) GROUP BY 1"))
def gra17(spark, d):
    """Cluster statistics with the absolute balance ratio as node risk."""
    lg, part = communities(spark, d)
    return cl.partition_risk(lg.edges, part, lg.metrics.select("wallet", F.abs("balance_ratio").alias("risk")))


EMB = "(SELECT c.component, c.wallet, e.embedding FROM cc_l c JOIN embeddings e ON e.vec_id = CAST(substr(c.wallet, 2) AS BIGINT) % (SELECT count(*) FROM embeddings))"


def wallet_embeddings(spark, d, wallets):
    """A vector per wallet, from the embeddings table."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.count(F.lit(1))).scalar()
    w = wallets.select("wallet", (F.substring("wallet", 2, 20).cast("bigint") % n).alias("vec_id"))
    return w.join(e.select("vec_id", "embedding"), "vec_id").select("wallet", "embedding")


@query("gra18", select(S(cluster_id="c.component"), I(size="any_value(c.n)", internal_edges="any_value(coalesce(e.k, 0))", external_edges="any_value(c.di + c.do - 2 * coalesce(e.k, 0))"),
                       D(density="any_value(CASE WHEN c.n > 1 THEN coalesce(e.k, 0) / (c.n * (c.n - 1)) ELSE 0 END)", avg_in_degree="any_value(c.di / c.n)", avg_out_degree="any_value(c.do / c.n)",
                         emb_mean_norm="sqrt(sum(v.mu * v.mu))", emb_std_mean="avg(v.sd)"), tail=f"""
FROM (SELECT component, count(*) n, sum(in_degree) di, sum(out_degree) AS "do" FROM cc_l JOIN nm_l USING (wallet) GROUP BY 1) c
LEFT JOIN (SELECT component, count(*) k FROM ed_l JOIN cc_l ON wallet = src GROUP BY 1) e USING (component)
JOIN (SELECT component, i, avg(x) mu, stddev_pop(x) sd FROM (SELECT component, generate_subscripts(embedding, 1) i, CAST(unnest(embedding) AS DOUBLE) x FROM {EMB}) GROUP BY 1, 2) v USING (component)
GROUP BY 1""").replace("c.do", 'c."do"'))
def gra18(spark, d):
    lg, part = communities(spark, d)
    return cl.community_features(lg.edges, lg.metrics, part, wallet_embeddings(spark, d, lg.nodes))


ROLE_FACTS = """(SELECT c.component AS cluster_id, c.wallet, m.in_degree AS i, m.out_degree AS o FROM cc_l c JOIN nm_l m USING (wallet))"""


@query("gra19", select(S(cluster_id="cluster_id", wallet="wallet", role="""CASE WHEN n = 1 THEN 'source'
  WHEN n_exit = 0 AND rank_out = 1 THEN 'exit' WHEN i = 0 OR wallet = entry THEN 'source' WHEN o = 0 THEN 'exit' ELSE 'layer' END"""), I(in_deg="i", out_deg="o"), tail=f"""
FROM (SELECT *, CASE WHEN wallet = entry THEN 0 ELSE row_number() OVER (PARTITION BY cluster_id, wallet = entry ORDER BY o, wallet) END AS rank_out
  FROM (SELECT *, count(*) OVER p AS n, count(*) FILTER (o = 0 AND i <> 0) OVER p AS n_exit,
    coalesce(min(CASE WHEN i = 0 THEN wallet END) OVER p, first_value(wallet) OVER (PARTITION BY cluster_id ORDER BY i, wallet)) AS entry
    FROM {ROLE_FACTS} WINDOW p AS (PARTITION BY cluster_id)))"""))
def gra19(spark, d):
    lg, part = communities(spark, d)
    return cl.flow_roles(lg.edges, part.select("wallet", F.col("community").alias("cluster_id")))


@query("gra20", sql("""SELECT component AS cluster_id, kind, count(*) AS n FROM (SELECT component, 'node' AS kind FROM cc_l
UNION ALL SELECT component, 'edge' FROM ed_l JOIN cc_l ON wallet = src) GROUP BY 1, 2"""))
def gra20(spark, d):
    """Element rows per cluster; the JSON text must name its key."""
    lg, part = communities(spark, d)
    el = cl.elements(lg.edges, part.select("wallet", F.col("community").alias("cluster_id")))
    first = F.split(F.col("key"), ">")[0]
    return el.where(F.col("element").contains(first)).groupBy("cluster_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("set1", sql("SELECT sender_wallet AS wallet FROM tx_w UNION SELECT receiver_wallet FROM tx_w"))
def set1(spark, d):
    return active_wallets(trailing_hours(transfers(spark, d)))


@query("agg16", select(S(wallet="wallet"), I(label="max(y)"), tail="""FROM (SELECT sender_wallet AS wallet, CASE WHEN label = 'illicit' THEN 1 ELSE 0 END AS y FROM tx_a WHERE label IS NOT NULL
UNION ALL SELECT receiver_wallet, CASE WHEN label = 'illicit' THEN 1 ELSE 0 END FROM tx_a WHERE label IS NOT NULL) GROUP BY 1"""))
def agg16(spark, d):
    from ..operators.training import wallet_labels

    return wallet_labels(transfers(spark, d))


@query("agg17", select(S(cluster_id="component"), D(illicit_fraction="avg(y)"), I(label="CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END"), tail="""
FROM cc_l JOIN (SELECT wallet, max(y) AS y FROM (SELECT sender_wallet AS wallet, CASE WHEN label = 'illicit' THEN 1 ELSE 0 END AS y FROM tx_l WHERE label IS NOT NULL
UNION ALL SELECT receiver_wallet, CASE WHEN label = 'illicit' THEN 1 ELSE 0 END FROM tx_l WHERE label IS NOT NULL) GROUP BY 1) USING (wallet) GROUP BY 1"""))
def agg17(spark, d):
    from ..operators.training import wallet_labels

    _, part = communities(spark, d)
    return cl.community_labels(part, wallet_labels(cell_transfers(spark, d)))


DENSITY = """SELECT component, CASE WHEN count(*) > 1 THEN any_value(coalesce(k, 0)) / (count(*) * (count(*) - 1)) ELSE 0 END AS dens
FROM cc_l LEFT JOIN (SELECT component, count(*) k FROM ed_l JOIN cc_l ON wallet = src GROUP BY 1) USING (component) GROUP BY 1"""


@query("agg17_density", select(S(cluster_id="component"), I(label="CASE WHEN dens > (SELECT quantile_cont(dens, 0.9) FROM comp_dens) THEN 1 ELSE 0 END"),
                               tail="FROM comp_dens", comp_dens=DENSITY))
def agg17_density(spark, d):
    """Community labels when no node labels exist: the densest tenth."""
    lg, part = communities(spark, d)
    return cl.community_labels(part, None, cl.community_features(lg.edges, lg.metrics, part))
