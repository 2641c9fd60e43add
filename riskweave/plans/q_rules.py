"""Queries over the rule registry, the rule vector and every rule with logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import applicability_counts
from ..functions.typology_names import label_of_rule
from ..operators import graph as g
from ..operators.cycles import ego_cycles
from ..operators.pagerank import pagerank
from ..operators.rules import enrich as en
from ..operators.rules.engine import confidences, evaluate, peel_edges, rule_aggregates, stored_ids, wallet_context
from ..operators.rules.registry import RuleBook, by_environment, by_lens, completeness
from ..sources.adapter import transfers
from .catalog import query
from .q_graph import RANK_BASE, RANK_STEPS
from .scoring import build_graph, wallet_rules
from .sql import D, I, S, select, sql

LIVE = [1, 4, 5, 6, 17, 21, 22, 23, 26, 35, 91, 92, 93, 94, 99, 100, 105, 183, 185]
CYCLIC = {17, 26, 105, 183}


def latest(tx):
    return tx.agg(F.max("timestamp")).scalar()


def base(spark, d, cycles=False, peel=False, structure=False, shares=None, extra=None, t=None):
    """Rule context with only the parts a rule needs."""
    t = transfers(spark, d) if t is None else t
    if cycles or structure:
        gr = build_graph(t)
        e, m = gr.edges, gr.metrics
    else:
        e = g.wallet_edges(t)
        m = g.node_metrics(e)
    parts = []
    if structure:
        parts.append(g.structural_features(m, g.neighbours(e)).select("wallet", "relay_pattern_score", "unique_counterparties"))
    if cycles:
        parts.append(ego_cycles(e))
    if peel:
        parts.append(peel_edges(e))
    return wallet_context(g.wallet_profiles(t, m), shares, *parts, as_of=latest(t), enrichment=extra)


def _live(i: int):
    def run(spark, d):
        ctx = base(spark, d, cycles=i in CYCLIC, peel=i == 91)
        return confidences(ctx, [i]).select("wallet", F.col(f"c{i}").alias("confidence"))

    run.__doc__ = f"Confidence of rule {i} per wallet."
    query(f"h{i}", select(S(wallet="wallet"), D(confidence=f"c{i}"), tail="FROM rc_a"))(run)


for _i in LIVE:
    _live(_i)


@query("h144", select(S(wallet="x.wallet"), D(confidence="CASE WHEN r > 0.5 THEN least(r, 1) ELSE 0 END"), tail="""
FROM (SELECT p.wallet, coalesce(n.r, 0) AS r FROM pf_a p LEFT JOIN (SELECT b.wallet, count(k.wallet) / count(*) AS r FROM nb_a b
LEFT JOIN (SELECT wallet FROM nm_a WHERE total_volume > 100000) k ON k.wallet = b.nb GROUP BY 1) n USING (wallet)) x"""))
def h144(spark, d):
    """Taint rule with high-volume wallets as the risky neighbours."""
    t = transfers(spark, d)
    gr = build_graph(t)
    risky = gr.metrics.where(F.col("total_volume") > 100000).select(F.col("wallet").alias("risky"))
    shares = g.risky_direct_share(gr.neighbours, risky)
    return confidences(base(spark, d, shares=shares, t=t), [144]).select("wallet", F.col("c144").alias("confidence"))


@query("h144_rank", select(S(wallet="x.wallet"), D(confidence="CASE WHEN r > 0.5 THEN least(r, 1) ELSE 0 END"), tail="""
FROM (SELECT p.wallet, coalesce(n.r, 0) AS r FROM pf_a p LEFT JOIN (SELECT b.wallet, count(k.wallet) / count(*) AS r FROM nb_a b
LEFT JOIN (SELECT wallet FROM rank_steps WHERE k = (SELECT min(k) FROM (SELECT k, sum(d) s FROM rank_steps WHERE k > 0 GROUP BY k) WHERE s < (SELECT count(*) FROM nd_a) * 1e-6) AND r > 0.01) k
ON k.wallet = b.nb GROUP BY 1) n USING (wallet)) x""", rank_base=RANK_BASE, rank_steps=RANK_STEPS))
def h144_rank(spark, d):
    """Taint rule with the PageRank threshold."""
    t = transfers(spark, d)
    gr = build_graph(t)
    shares = g.risky_direct_share(gr.neighbours, g.risky_nodes(pagerank(gr.edges, gr.nodes)))
    return confidences(base(spark, d, shares=shares, t=t), [144]).select("wallet", F.col("c144").alias("confidence"))


# ---- rules whose inputs are optional -------------------------------------------------------------------------


def supplied(tx):
    """A caller's wallet table: scores and counts read from the wallet's own sends."""

    def share(kind):
        return F.avg((F.col("asset_type") == kind).cast("double"))

    return tx.groupBy(F.col("sender_wallet").alias("wallet")).agg(
        F.least(2 * share("view"), F.lit(1.0)).alias("change_address_reuse_ratio"),
        F.count_if(F.col("asset_type") == "click").alias("coinjoin_tx_count"),
        F.least(2 * share("error"), F.lit(1.0)).alias("nft_wash_trade_score"),
        F.count_if(F.col("asset_type") == "error").alias("nft_self_trade_count"),
        F.least(2 * share("signup"), F.lit(1.0)).alias("nft_royalty_self_ratio"),
        F.least(2 * share("purchase"), F.lit(1.0)).alias("token_pump_score"),
        F.least(2 * share("click"), F.lit(1.0)).alias("sybil_cluster_score"),
        F.count_if(F.col("asset_type") == "purchase").alias("stablecoin_mint_redeem_cycles"),
        share("view").alias("nested_vasp_exposure_score"),
        (2 * share("view")).alias("cross_exchange_arb_score"),
        share("error").alias("pre_review_risk_score"),
        share("click").alias("post_review_risk_score"),
        (3 * share("signup")).alias("behavior_shift_after_review"),
        (F.count_if(F.col("label") == "illicit") >= 2).alias("csam_flagged"),
    )


def share_sql(kind: str) -> str:
    return f"avg(CASE WHEN asset_type = '{kind}' THEN 1.0::DOUBLE ELSE 0 END)"


SUPPLIED = f"""SELECT sender_wallet AS wallet, least(2 * {share_sql('view')}, 1) AS change, count(*) FILTER (asset_type = 'click') AS coin,
  least(2 * {share_sql('error')}, 1) AS wash, count(*) FILTER (asset_type = 'error') AS selfs, least(2 * {share_sql('signup')}, 1) AS royalty,
  least(2 * {share_sql('purchase')}, 1) AS pump, least(2 * {share_sql('click')}, 1) AS sybil, count(*) FILTER (asset_type = 'purchase') AS mint,
  {share_sql('view')} AS vasp, 2 * {share_sql('view')} AS arb, {share_sql('error')} AS pre, {share_sql('click')} AS post, 3 * {share_sql('signup')} AS shift,
  count(*) FILTER (label = 'illicit') >= 2 AS csam FROM tx_a GROUP BY 1"""
FROM_SUPPLIED = {
    101: "CASE WHEN change > 0.7 THEN least(change, 1) ELSE 0 END",
    102: "CASE WHEN coin > 0 THEN least(coin / 5, 1) ELSE 0 END",
    132: "CASE WHEN wash > 0.6 OR selfs >= 3 THEN greatest(wash, least(selfs / 5, 1)) ELSE 0 END",
    133: "CASE WHEN royalty > 0.5 THEN least(royalty, 1) ELSE 0 END",
    134: "CASE WHEN pump > 0.6 THEN least(pump, 1) ELSE 0 END",
    135: "CASE WHEN sybil > 0.5 THEN least(sybil, 1) ELSE 0 END",
    136: "CASE WHEN mint >= 3 THEN least(mint / 6, 1) ELSE 0 END",
    142: "CASE WHEN vasp > 0.4 THEN least(vasp, 1) ELSE 0 END",
    149: "CASE WHEN arb > 0.5 THEN least(arb, 1) ELSE 0 END",
    172: "CASE WHEN abs(pre - post) > 0.3 AND shift > 0.5 THEN least(abs(pre - post) + 0.5 * shift, 1) ELSE 0 END",
    182: "CASE WHEN csam THEN 0.95 ELSE 0 END",
}


def optional_rule(i: int, statement: str, extra, **parts) -> None:
    """Register a rule over the inputs ``extra(tx)`` derives."""

    def run(spark, d):
        t = transfers(spark, d)
        ctx = base(spark, d, extra=extra(spark, d, t), t=t, **parts)
        return confidences(ctx, [i]).select("wallet", F.col(f"c{i}").alias("confidence"))

    run.__doc__ = f"Confidence of rule {i} per wallet with its optional inputs present."
    query(f"h{i}", statement)(run)


for _i, _expr in FROM_SUPPLIED.items():
    optional_rule(
        _i, select(S(wallet="p.wallet"), D(confidence=f"coalesce({_expr}, 0)"), tail="FROM pf_a p LEFT JOIN sup USING (wallet)", sup=SUPPLIED),
        lambda spark, d, t: supplied(t),
    )

DORM = """SELECT wallet, coalesce(max(epoch_us(timestamp) - epoch_us(p)), 0) / 1e6 / 86400 AS days FROM (
  SELECT *, lag(timestamp) OVER (PARTITION BY wallet ORDER BY timestamp, ord) AS p FROM ro_a) GROUP BY 1"""
optional_rule(
    31, select(S(wallet="p.wallet"), D(confidence="CASE WHEN days * 40 > 180 AND total_in + total_out > 10000 THEN least(days * 40 / 730, 1) ELSE 0 END"),
               tail="FROM pf_a p JOIN dorm USING (wallet)", dorm=DORM),
    # the tables cover one month; pauses are stretched so the rule has something to find
    lambda spark, d, t: en.dormancy(t).withColumn("dormancy_days", F.col("dormancy_days") * 40),
)
optional_rule(
    95, select(S(wallet="p.wallet"), D(confidence="CASE WHEN n >= 5 AND k / n > 0.5 AND k >= 5 THEN k / n ELSE 0 END"), tail="""FROM pf_a p
LEFT JOIN (SELECT receiver_wallet AS wallet, count(*) n, count(*) FILTER (amount <= 4000) k FROM tx_a GROUP BY 1) USING (wallet)"""),
    lambda spark, d, t: en.inflows(t, 4000.0),
)


def sender_groups(t):
    """Wallets of one user as one community."""
    w = t.select(F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet")).distinct()
    return w.withColumn("community", F.floor(F.substring("wallet", 2, 20).cast("bigint") / 5000).cast("string"))


GROUP = "CAST(substr({c}, 2) AS BIGINT) // 5000"
optional_rule(
    96, select(S(wallet="p.wallet"), D(confidence="CASE WHEN k >= 3 THEN least(k / 10, 1) ELSE 0 END"), tail=f"""FROM pf_a p LEFT JOIN (
SELECT wallet, count(*) k FROM (SELECT src AS wallet, src, dst FROM ed_a UNION ALL SELECT dst, src, dst FROM ed_a)
WHERE {GROUP.format(c='src')} = {GROUP.format(c='dst')} GROUP BY 1) USING (wallet)"""),
    lambda spark, d, t: en.cluster_edges(g.wallet_edges(t), sender_groups(t)),
)
optional_rule(
    97, select(S(wallet="p.wallet"), D(confidence="CASE WHEN u >= 10 AND r > 0.8 THEN least(r * u / 20, 1) ELSE 0 END"), tail="""FROM pf_a p LEFT JOIN (
SELECT sender_wallet AS wallet, count(*) u, avg(CASE WHEN f >= s THEN 1.0::DOUBLE ELSE 0 END) r FROM (
  SELECT sender_wallet, receiver_wallet, min(timestamp) f, max(timestamp) l, (SELECT max(timestamp) FROM tx_a) - INTERVAL 600 HOUR AS s FROM tx_a GROUP BY 1, 2)
WHERE l >= s GROUP BY 1) USING (wallet)"""),
    # 25 days, so that wallets reach ten recipients
    lambda spark, d, t: en.new_recipients(t, 600),
)
INTERVALS = """SELECT sender_wallet AS wallet, count(gap) n, avg(gap) mu, stddev_pop(gap) sd, count(hop) hn, avg(hop) hm, min(hop) hl, count(DISTINCT chain_id) ch
FROM (SELECT *, CASE WHEN chain_id <> pc THEN gap END AS hop FROM (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6 AS gap,
  lag(chain_id) OVER w AS pc FROM TX WINDOW w AS (PARTITION BY sender_wallet ORDER BY timestamp, ord))) GROUP BY 1"""
# sends at one transfer per (wallet, day) are regular enough to exercise the interval rules
EVEN = """(SELECT * REPLACE (date_trunc('day', timestamp) AS timestamp) FROM tx_a)"""


def even(t):
    return t.withColumn("timestamp", F.date_trunc("day", "timestamp"))


for _i, _n, _lim, _k in ((98, 3, "0.2", 1), (161, 5, "0.05", 10)):
    optional_rule(
        _i, select(S(wallet="p.wallet"), D(confidence=f"CASE WHEN n >= {_n} AND mu <> 0 AND sd / mu < {_lim} THEN greatest(1 - {_k} * sd / mu, 0) ELSE 0 END"),
                   tail="FROM pf_a p LEFT JOIN iv USING (wallet)", iv=INTERVALS.replace("TX", EVEN)),
        lambda spark, d, t: en.send_intervals(even(t)),
    )
# here the chain of a transfer is its asset type and a hop of days counts as seconds
FAST = """(SELECT * REPLACE (asset_type AS chain_id, make_timestamp(epoch_us(timestamp) // 20000) AS timestamp) FROM tx_a)"""
optional_rule(
    165, select(S(wallet="p.wallet"), D(confidence="CASE WHEN hn >= 2 AND hl < 5 AND hm < 30 AND ch >= 2 THEN least((1 / greatest(hm, 0.1)) * 5 * ch / 3, 1) ELSE 0 END"),
                tail="FROM pf_a p LEFT JOIN iv USING (wallet)", iv=INTERVALS.replace("TX", FAST)),
    lambda spark, d, t: en.send_intervals(
        t.withColumns({"chain_id": F.col("asset_type"), "timestamp": F.timestamp_micros(F.floor(F.unix_micros("timestamp") / 20000).cast("bigint"))})
    ),
)
BANDS = ", ".join(f"count(*) FILTER (amount >= 0.8 * {t} AND amount < {t}) / count(*)" for t in (1000, 3000, 10000, 15000, 50000))
optional_rule(
    162, select(S(wallet="p.wallet"), D(confidence="CASE WHEN b > 0.4 AND v > 0.01 THEN least(1.5 * b, 1) ELSE 0 END"), tail=f"""FROM pf_a p LEFT JOIN (
SELECT sender_wallet AS wallet, greatest({BANDS}) b, var_pop(amount) / (avg(amount) * avg(amount)) v FROM (
  SELECT *, row_number() OVER (PARTITION BY sender_wallet ORDER BY timestamp DESC, ord DESC) r FROM tx_a) WHERE r <= 50 GROUP BY 1) USING (wallet)"""),
    lambda spark, d, t: en.recent_sends(t),
)


def tag_table(tx):
    """Address tags with validity: senders of large or illicit transfers, by asset type."""
    kinds = F.create_map(*[F.lit(x) for p in (("view", "mixer"), ("error", "darknet"), ("click", "ransomware"), ("purchase", "sanctioned"), ("signup", "scam")) for x in p])
    big = tx.where(F.col("amount") >= 15000)
    tags = big.select(
        F.col("sender_wallet").alias("wallet_address"), kinds[F.col("asset_type")].alias("tag"),
        (F.col("timestamp") - F.expr("INTERVAL 20 DAYS")).alias("valid_from"), (F.col("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("valid_to"),
    )
    exchange = tx.where((F.col("amount") >= 12000) & (F.col("amount") < 15000)).select(
        F.col("receiver_wallet").alias("wallet_address"), F.lit("exchange").alias("tag"),
        F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return tags.unionByName(exchange)


TAGS = """SELECT sender_wallet AS wallet_address, CASE asset_type WHEN 'view' THEN 'mixer' WHEN 'error' THEN 'darknet' WHEN 'click' THEN 'ransomware'
  WHEN 'purchase' THEN 'sanctioned' ELSE 'scam' END AS tag, timestamp - INTERVAL 20 DAY AS valid_from, timestamp + INTERVAL 2 DAY AS valid_to FROM tx_h
UNION ALL SELECT receiver_wallet, 'exchange', NULL, NULL FROM tx_a WHERE amount >= 12000 AND amount < 15000"""
TAG_HITS = """SELECT w AS wallet, coalesce(bool_or(tag <> 'exchange'), false) AS risky, coalesce(bool_or(tag = 'sanctioned'), false) AS sanctioned,
  coalesce(bool_or(tag = 'ransomware'), false) AS ransomware, coalesce(bool_or(tag = 'scam'), false) AS scam, coalesce(bool_or(tag = 'darknet'), false) AS darknet,
  coalesce(bool_or(tag = 'exchange'), false) AS exchange
FROM (SELECT sender_wallet AS w, sender_wallet AS o, timestamp FROM tx_a UNION ALL SELECT sender_wallet, receiver_wallet, timestamp FROM tx_a
  UNION ALL SELECT receiver_wallet, receiver_wallet, timestamp FROM tx_a UNION ALL SELECT receiver_wallet, sender_wallet, timestamp FROM tx_a)
JOIN tags ON wallet_address = o AND (valid_from IS NULL OR timestamp >= valid_from) AND (valid_to IS NULL OR timestamp <= valid_to) GROUP BY 1"""


@query("joi12", select(S(wallet="wallet", tag_risky="risky", near_exchange="exchange", tag_scam="scam"), tail="FROM tag_hits", tags=TAGS, tag_hits=TAG_HITS))
def joi12(spark, d):
    t = transfers(spark, d)
    return en.tag_flags(t, tag_table(t)).select("wallet", "tag_risky", "near_exchange", "tag_scam")


@query("joi12_global", sql("SELECT wallet, true AS tag_risky, true AS tag_scam FROM pf_a"))
def joi12_global(spark, d):
    """Any tag counts for every wallet."""
    t = transfers(spark, d)
    return en.tag_flags(t, tag_table(t), scope="global").select("wallet", "tag_risky", "tag_scam")


MULE = "total_in <> 0 AND total_out / total_in > 0.9"
VAGUE = "relay_pattern_score / (unique_counterparties + 1)"
TAGGED = {
    141: f"CASE WHEN {MULE} AND risky THEN least(1.2 * total_out / total_in, 1) ELSE 0 END",
    176: "CASE WHEN sanctioned THEN 0.9 ELSE 0 END",
    179: "CASE WHEN ransomware THEN 0.8 ELSE 0 END",
    180: "CASE WHEN scam THEN least(0.8 + CASE WHEN p.in_degree >= 15 THEN p.in_degree / 50 ELSE 0 END, 1) ELSE 0 END",
    181: "CASE WHEN darknet THEN 0.85 ELSE 0 END",
    184: f"CASE WHEN risky AND {VAGUE} > 0.5 THEN least({VAGUE} + 0.3, 1) ELSE 0 END",
}
for _i, _expr in TAGGED.items():
    optional_rule(
        _i, select(S(wallet="p.wallet"), D(confidence=f"coalesce({_expr}, 0)"), tail="FROM pf_a p LEFT JOIN st_a s USING (wallet) LEFT JOIN tag_hits USING (wallet)", tags=TAGS, tag_hits=TAG_HITS),
        lambda spark, d, t: en.tag_flags(t, tag_table(t)).drop("near_exchange"), structure=_i == 184,
    )


@query("h185_tags", select(S(wallet="p.wallet"), D(confidence=f"CASE WHEN {MULE} THEN least(least(total_out / total_in, 1) + CASE WHEN risky THEN 0.2 ELSE 0 END, 1) ELSE 0 END"),
                           tail="FROM pf_a p LEFT JOIN tag_hits USING (wallet)", tags=TAGS, tag_hits=TAG_HITS))
def h185_tags(spark, d):
    t = transfers(spark, d)
    return confidences(base(spark, d, extra=en.tag_flags(t, tag_table(t)), t=t), [185]).select("wallet", F.col("c185").alias("confidence"))


SCREEN = """SELECT n.wallet, count(*) AS nn, count(w.wallet_address) AS hit FROM nb_a n
LEFT JOIN (SELECT DISTINCT wallet_address FROM tags WHERE tag <> 'exchange') w ON w.wallet_address = n.nb GROUP BY 1"""
STEPS = """SELECT wallet_address AS wallet, 0 AS steps FROM tags WHERE tag = 'exchange'
UNION SELECT n.nb, s.steps + 1 FROM steps s JOIN nb_a n USING (wallet) WHERE s.steps < 10"""


@query("set3", select(S(wallet="wallet"), I(neighbour_n="nn", screened_overlap="hit"), D(avoidance_ratio="1 - hit / nn"), tail="FROM screen", tags=TAGS, screen=SCREEN))
def set3(spark, d):
    """Neighbours against the screened wallets."""
    t = transfers(spark, d)
    watched = tag_table(t).where(F.col("tag") != "exchange").select(F.col("wallet_address").alias("wallet"))
    return en.screening(g.wallet_edges(t), watched).drop("screening_known")


optional_rule(
    163, select(S(wallet="p.wallet"), D(confidence="CASE WHEN p.in_graph AND 1 - hit / nn > 0.95 AND nn >= 5 AND 3 * coalesce(steps, 0) > 4 THEN 1 - hit / nn ELSE 0 END"),
                tail="FROM pf_a p LEFT JOIN screen USING (wallet) LEFT JOIN (SELECT wallet, min(steps) AS steps FROM steps GROUP BY 1) USING (wallet)",
                tags=TAGS, screen=SCREEN, steps=STEPS),
    # graph distances are short here, so each step counts three
    lambda spark, d, t: en.screening(g.wallet_edges(t), tag_table(t).where(F.col("tag") != "exchange").select(F.col("wallet_address").alias("wallet"))).join(
        en.distance_to(g.wallet_edges(t), tag_table(t).where(F.col("tag") == "exchange").select(F.col("wallet_address").alias("wallet")))
        .withColumn("avg_path_length_to_exchange", 3 * F.col("avg_path_length_to_exchange")), "wallet", "full_outer"),
)
SYNCED = f"""SELECT sender_wallet AS wallet, avg(CASE WHEN near >= 2 THEN 1.0::DOUBLE ELSE 0 END) AS sync, any_value({GROUP.format(c='sender_wallet')}) AS grp
FROM (SELECT *, count(*) OVER (PARTITION BY receiver_wallet ORDER BY timestamp RANGE BETWEEN INTERVAL 200000 SECOND PRECEDING AND INTERVAL 200000 SECOND FOLLOWING) AS near FROM tx_a) GROUP BY 1"""
GROUP_SIZE = f"SELECT {GROUP.format(c='wallet')} AS grp, count(*) AS size FROM pf_a GROUP BY 1"
optional_rule(
    164, select(S(wallet="p.wallet"), D(confidence="CASE WHEN sync > 0.7 AND size >= 5 THEN least(sync * size / 10, 1) ELSE 0 END"),
                tail="FROM pf_a p LEFT JOIN synced USING (wallet) LEFT JOIN gsize USING (grp)", synced=SYNCED, gsize=GROUP_SIZE),
    # a two-day radius, so that wallets reach a high share
    lambda spark, d, t: en.synchrony(t, g.wallet_edges(t), sender_groups(t), 200000),
)
ROLES = f"""SELECT grp, count(DISTINCT role) AS kinds FROM (SELECT *, CASE WHEN n = 1 THEN 'source' WHEN n_exit = 0 AND rk = 1 THEN 'exit'
  WHEN i = 0 OR wallet = entry THEN 'source' WHEN o = 0 THEN 'exit' ELSE 'layer' END AS role
FROM (SELECT *, CASE WHEN wallet = entry THEN 0 ELSE row_number() OVER (PARTITION BY grp, wallet = entry ORDER BY o, wallet) END AS rk
FROM (SELECT *, count(*) OVER p AS n, count(*) FILTER (o = 0 AND i <> 0) OVER p AS n_exit,
  coalesce(min(CASE WHEN i = 0 THEN wallet END) OVER p, first_value(wallet) OVER (PARTITION BY grp ORDER BY i, wallet)) AS entry
FROM (SELECT f.wallet, {GROUP.format(c='f.wallet')} AS grp,
  (SELECT count(*) FROM ed_a WHERE dst = f.wallet AND {GROUP.format(c='src')} = {GROUP.format(c='f.wallet')}) AS i,
  (SELECT count(*) FROM ed_a WHERE src = f.wallet AND {GROUP.format(c='dst')} = {GROUP.format(c='f.wallet')}) AS o FROM pf_a f) WINDOW p AS (PARTITION BY grp)))) GROUP BY 1"""
optional_rule(
    175, select(S(wallet="p.wallet"), D(confidence="CASE WHEN sync > 0.5 AND kinds >= 3 AND v > 0.5 THEN least(0.4 * sync + 0.3 * kinds / 6 + 0.3 * v, 1) ELSE 0 END"),
                tail=f"""FROM (SELECT pf_a.wallet, 40 * {VAGUE} AS v FROM pf_a LEFT JOIN st_a USING (wallet)) p
LEFT JOIN synced USING (wallet) LEFT JOIN role_kinds USING (grp)""", synced=SYNCED, role_kinds=ROLES),
    # relay scores are scaled up so that the rule fires somewhere
    lambda spark, d, t: en.synchrony(t, g.wallet_edges(t), sender_groups(t), 200000).join(
        _scaled_relay(t), "wallet", "full_outer"),
)


def _scaled_relay(t):
    e = g.wallet_edges(t)
    f = g.structural_features(g.node_metrics(e), g.neighbours(e))
    return f.select("wallet", (40 * F.col("relay_pattern_score")).alias("relay_pattern_score"), "unique_counterparties")


# ---- registry and vector -------------------------------------------------------------------------------------


def rules_per_wallet(spark, d):
    t = transfers(spark, d)
    gr = build_graph(t)
    none = gr.nodes.select("wallet", F.lit(0.0).alias("suspicious_neighbor_ratio_1hop"))
    return wallet_rules(t, gr, none, latest(t))


@query("src5", sql("SELECT CAST(id AS BIGINT) AS id, name, count(*) AS wallets FROM rl_a GROUP BY 1, 2"))
def src5(spark, d):
    """Registry entries with the number of wallets each fires for."""
    fired = rules_per_wallet(spark, d).select(F.explode("triggered_ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("wallets"))
    return RuleBook.standard().table(spark).join(fired, "id").select("id", "name", "wallets")


@query("src5_filters", sql("""SELECT count(DISTINCT CASE WHEN id <= 90 THEN id END) AS traditional,
count(DISTINCT CASE WHEN id IN (1, 5, 6, 4, 22, 23, 35, 91, 94, 99, 105) THEN id END) AS behavioral FROM rl_a"""))
def src5_filters(spark, d):
    """Fired rules of one environment and of one lens."""
    fired = rules_per_wallet(spark, d).select(F.explode("triggered_ids").alias("id")).distinct()
    reg = RuleBook.standard().table(spark)
    a = by_environment(reg, "traditional").join(fired, "id").agg(F.count(F.lit(1)).alias("traditional"))
    return a.withColumn("behavioral", by_lens(reg, "behavioral").join(fired, "id").agg(F.count(F.lit(1))).scalar())


@query("joi9", sql("SELECT CAST(0 AS BIGINT) AS problems, count(*) AS fired_known FROM rl_a"))
def joi9(spark, d):
    """Registry completeness, and every fired id resolves in the registry."""
    reg = RuleBook.standard().table(spark)
    fired = rules_per_wallet(spark, d).select(F.explode("triggered_ids").alias("id"))
    known = fired.join(reg, "id", "left_semi").agg(F.count(F.lit(1)).alias("fired_known"))
    return known.withColumn("problems", completeness(reg).agg(F.count(F.lit(1))).scalar())


@query("rul0", sql("SELECT wallet, CAST(4 * (NOT in_graph)::INT AS BIGINT) AS inapplicable FROM pf_a"))
def rul0(spark, d):
    """Slots without their inputs: the four cycle rules on wallets outside the graph."""
    r = rules_per_wallet(spark, d)
    return r.select("wallet", applicability_counts(F.col("applicability_vector"))["missing_data"].alias("inapplicable"))


@query("rul_v", select(S(wallet="p.wallet", ids="coalesce(r.ids, '')"), I(fired="coalesce(r.fired, 0)"), D(total="coalesce(r.fired * r.mean_conf, 0)"), tail="FROM pf_a p LEFT JOIN rs_a r USING (wallet)"))
def rul_v(spark, d):
    """Fired ids and the vector's sum per wallet."""
    r = rules_per_wallet(spark, d)
    total = F.aggregate("heuristic_vector", F.lit(0.0), lambda a, x: a + x)
    return r.select("wallet", F.array_join("triggered_ids", ",").alias("ids"), F.col("heuristic_triggered_count").alias("fired"), total.alias("total"))


_PASSED = "total_out / total_in"
# fixed values: what each rule that fires on the transfers alone tells, as format and values
TOLD = {
    1: ("%d of %d amounts are below 10000", "n_below_10000", "tx_count"), 4: ("%d different payers", "in_degree"), 5: ("%d of %d amounts are round hundreds", "n_round_100", "tx_count"),
    6: ("%.2f of an average amount is kept", "balance / avg_amount"), 17: ("%d payment cycles of up to four wallets", "c2 + c3 + c4"), 21: ("%d payers and %d payees", "in_degree", "out_degree"),
    22: ("%d payers, %.2f of the inflow goes out", "in_degree", f"coalesce({_PASSED}, 0)"), 23: ("%.2f of the inflow goes out", _PASSED), 26: ("%d payment cycles of up to three wallets", "c2 + c3"),
    35: ("%d of %d amounts are below 3000", "n_below_3000", "tx_count"), 91: ("%d of %d payments are smaller than the one before", "peel_drops", "peel_edges - 1"), 92: ("%d different payees", "out_degree"),
    93: ("%d different payers", "in_degree"), 94: ("%d days old at a volume of %.2f", "floor(epoch((SELECT max(timestamp) FROM tx_a) - first_seen) / 86400)", "total_in + total_out"),
    99: ("%d of %d amounts are below 10000", "n_below_10000", "tx_count"), 100: ("%d payers, 0.00 of them young", "in_degree"), 105: ("%d payment cycles of up to six wallets", "c2 + c3 + c4 + c5 + c6"),
    183: ("%d payment cycles of up to five wallets, %.2f of the inflow goes out", "c2 + c3 + c4 + c5", _PASSED), 185: ("%.2f of the inflow goes out", _PASSED),
}


def _printed(text: str, *values: str) -> str:
    kinds = [p[0] for p in text.split("%")[1:]]
    put = ", ".join(f"CAST({v} AS BIGINT)" if k == "d" else f"round(CAST({v} AS DOUBLE) + 1e-9, 2)" for k, v in zip(kinds, values))
    return f"printf('{text}', {put})"


@query("rul_e", sql("SELECT wallet, CAST(id AS VARCHAR) AS rule_id, printf('%s: %s (confidence %.2f)', name, CASE id "
                    + " ".join(f"WHEN {i} THEN {_printed(*t)}" for i, t in TOLD.items()) + " END, round(conf + 1e-9, 2)) AS explanation FROM rl_a JOIN pf_a USING (wallet) LEFT JOIN cy_a USING (wallet) LEFT JOIN pe_a USING (wallet)"))
def rul_e(spark, d):
    """Explanations of fired rules, one row each."""
    return rules_per_wallet(spark, d).select("wallet", F.explode("heuristic_explanations").alias("rule_id", "explanation"))


@query("rul_a", select(S(wallet="p.wallet"), I(n="coalesce(fired, 0)"), D(mean="coalesce(mean_conf, 0)", top="coalesce(top_conf, 0)", ratio="coalesce(fired, 0) / 185"), tail="FROM pf_a p LEFT JOIN rs_a USING (wallet)"))
def rul_a(spark, d):
    a = rule_aggregates(F.col("heuristic_vector"), F.col("heuristic_top_confidence"))
    return rules_per_wallet(spark, d).select(
        "wallet", a["heuristic_nonzero_count"].alias("n"), a["heuristic_mean"].alias("mean"), a["heuristic_top"].alias("top"), a["heuristic_triggered_ratio"].alias("ratio")
    )


@query("top2", select(S(wallet="wallet", top5="string_agg(id, ',' ORDER BY conf DESC, id)", top_name="arg_min(name, r)"), tail="""
FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY round(conf, 12) DESC, id) r FROM rl_a) WHERE r <= 5 GROUP BY 1"""))
def top2(spark, d):
    r = rules_per_wallet(spark, d).where(F.col("heuristic_triggered_count") > 0)
    return r.select("wallet", F.array_join(F.transform("top_rules", lambda x: x["id"]), ",").alias("top5"), F.col("heuristic_top_typology").alias("top_name"))


@query("set4", sql("SELECT wallet, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT wallet, id FROM rl_a UNION ALL SELECT wallet, 2 FROM pf_a) GROUP BY 1"))
def set4(spark, d):
    """Stored ids from a list holding only rule 2 and the vector."""
    r = rules_per_wallet(spark, d)
    return r.select("wallet", F.array_join(stored_ids(F.array(F.lit(2)), F.col("heuristic_vector")), ",").alias("ids"))


@query("udf1", sql("SELECT wallet, CAST(fired AS BIGINT) AS fired FROM (SELECT p.wallet, coalesce(r.fired, 0) + (p.tx_count >= 20)::INT AS fired FROM pf_a p LEFT JOIN rs_a r USING (wallet))"))
def udf1(spark, d):
    """A custom rule registered next to the built-in ones."""
    book = RuleBook.standard()
    book.register(186, "BusyWallet", "traditional", ["behavioral"], ["amount"], F.col("tx_count") >= 20, F.lit(0.5))
    ctx = base(spark, d, cycles=True, peel=True, structure=True)
    return evaluate(ctx, book).select("wallet", F.col("heuristic_triggered_count").alias("fired"))


@query("agg13", sql("""SELECT top_name AS typology, count(*) AS n, (SELECT count(*) FROM rs_a) AS total_scored,
(SELECT top_name FROM rs_a GROUP BY 1 ORDER BY count(*) DESC, top_name LIMIT 1) AS most_common FROM rs_a GROUP BY 1"""))
def agg13(spark, d):
    from ..operators.views import rule_statistics

    return rule_statistics(rules_per_wallet(spark, d).where(F.col("heuristic_triggered_count") > 0))["typologies"]


@query("agg13_ids", sql("SELECT CAST(id AS BIGINT) AS id, count(*) AS n FROM rl_a GROUP BY 1"))
def agg13_ids(spark, d):
    from ..operators.views import rule_statistics

    return rule_statistics(rules_per_wallet(spark, d))["ids"]


@query("agg15", sql("SELECT wallet, CAST(185 - 4 * (NOT in_graph)::INT AS BIGINT) AS applicable, CAST(4 * (NOT in_graph)::INT AS BIGINT) AS missing_data, CAST(0 AS BIGINT) AS out_of_scope, CAST(185 AS BIGINT) AS total FROM pf_a"))
def agg15(spark, d):
    c = applicability_counts(F.col("applicability_vector"))
    return rules_per_wallet(spark, d).select("wallet", *[v.alias(k) for k, v in c.items()])


@query("agg18", sql("SELECT count(*) AS fired_slots, count(DISTINCT id) AS fired_ids FROM rl_a"))
def agg18(spark, d):
    r = rules_per_wallet(spark, d).select(F.explode("triggered_ids").alias("id"))
    return r.agg(F.count(F.lit(1)).alias("fired_slots"), F.countDistinct("id").alias("fired_ids"))


@query("sca10", sql("""SELECT name, CASE name WHEN 'PeelChain' THEN 'peel chain' WHEN 'FanOutDispersal' THEN 'fan-out' WHEN 'FanInAggregation' THEN 'many-to-one collection'
WHEN 'ConsolidationAfterObfuscation' THEN 'reconsolidation' WHEN 'CrossWalletChainLoops' THEN 'cross-chain bridge hop' WHEN 'LayeredHopsFreshWallets' THEN 'layering' END AS label, count(*) AS n
FROM rl_a GROUP BY 1, 2"""))
def sca10(spark, d):
    """Fired rule names mapped to typology labels."""
    names = RuleBook.standard().table(spark).select("id", "name")
    fired = rules_per_wallet(spark, d).select(F.explode("triggered_ids").alias("id")).join(names, "id")
    return fired.groupBy("name", label_of_rule(F.col("name")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


