"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk, scalars, text
from ..functions.typology_names import normalise_truth, truth_label
from ..operators.fusion import fixed_columns
from ..operators.tx_features import amount_features
from ..sources.adapter import table, transfers
from ..sources.transfers import hourly_time
from .catalog import query
from .sql import D, I, S, T, select, sql


@query("sca1", select(S(transaction_id="transaction_id"), D(log_amount="ln(1 + greatest(amount, 0))"), tail="FROM tx_a"))
def sca1(spark, d):
    return amount_features(transfers(spark, d)).select("transaction_id", "log_amount")


@query("sca2", select(S(transaction_id="transaction_id", is_round_amount="amount % 10 = 0"), tail="FROM tx_a"))
def sca2(spark, d):
    return amount_features(transfers(spark, d)).select("transaction_id", "is_round_amount")


@query("sca3", select(S(transaction_id="transaction_id"), D(fee_ratio="CASE WHEN amount <> 0 AND fee IS NOT NULL THEN fee / amount ELSE 0 END"), tail="FROM tx_a"))
def sca3(spark, d):
    return amount_features(transfers(spark, d)).select("transaction_id", "fee_ratio")


ENT = "(SELECT sender_wallet, amount / sum(amount) OVER (PARTITION BY sender_wallet) AS p FROM tx_a WHERE amount > 0)"


def shares(spark, d):
    t = transfers(spark, d).where(F.col("amount") > 0)
    total = t.groupBy("sender_wallet").agg(F.sum("amount").alias("total"))
    return t.join(total, "sender_wallet").select("sender_wallet", (F.col("amount") / F.col("total")).alias("p"))


@query("sca4", select(S(sender_wallet="sender_wallet"), D(entropy="sum(-p * ln(p + 1e-12))"), tail=f"FROM {ENT} GROUP BY 1"))
def sca4(spark, d):
    """Entropy of each sender's amounts."""
    return shares(spark, d).groupBy("sender_wallet").agg(F.sum(scalars.entropy_term(F.col("p"))).alias("entropy"))


@query("sca5", select(S(sender_wallet="sender_wallet"), D(entropy="CASE WHEN count(*) > 1 THEN sum(-p * ln(p + 1e-12)) / (ln(count(*)) + 1e-12) ELSE 0 END"), tail=f"FROM {ENT} GROUP BY 1"))
def sca5(spark, d):
    h = shares(spark, d).groupBy("sender_wallet").agg(F.sum(scalars.entropy_term(F.col("p"))).alias("h"), F.count(F.lit(1)).alias("n"))
    return h.select("sender_wallet", scalars.normalised_entropy(F.col("h"), F.col("n")).alias("entropy"))


SCORE = "((ord * 37) % 1000) / 1000.0::DOUBLE"
LEVEL = "CASE WHEN {s} >= 0.9 THEN 'high' WHEN {s} >= 0.75 THEN 'medium' WHEN {s} <= 0.3 THEN 'low' ELSE 'medium-low' END"


def derived_score():
    """A score spread over [0, 1) so that every branch occurs."""
    return ((F.col("ord") * 37) % 1000) / 1000.0


@query("sca6", select(S(transaction_id="transaction_id", level=f"CASE WHEN ord % 11 = 0 THEN 'low' ELSE {LEVEL.format(s=SCORE)} END"), tail="FROM tx_a"))
def sca6(spark, d):
    s = F.when(F.col("ord") % 11 == 0, None).otherwise(derived_score())
    return transfers(spark, d).select("transaction_id", risk.level_from_score(s).alias("level"))


@query("sca7", select(S(transaction_id="transaction_id", level=f"CASE WHEN ord % 7 = 3 THEN 'high' ELSE {LEVEL.format(s=SCORE)} END"),
                      I(rank=f"CASE WHEN ord % 7 = 3 THEN 3 ELSE CASE {LEVEL.format(s=SCORE)} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'medium-low' THEN 1 ELSE 0 END END"), tail="FROM tx_a"))
def sca7(spark, d):
    """The most severe of the score's level, a padded level and an unknown word."""
    other = F.when(F.col("ord") % 7 == 3, F.lit("  HIGH ")).otherwise(F.lit("unheard of"))
    level = risk.max_level(risk.level_from_score(derived_score()), other)
    return transfers(spark, d).select("transaction_id", level.alias("level"), risk.level_rank(level).alias("rank"))


@query("sca8", select(S(doc_id="doc_id", bad="""coalesce(t IN ('illicit', 'fraud', 'suspicious', 'malicious', 'scam', 'true', '1', 'yes')
OR contains(t, 'illicit') OR contains(t, 'fraud') OR contains(t, 'suspic'), false)"""), tail="FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)"))
def sca8(spark, d):
    """Label check on free text."""
    return table(spark, d, "documents").select("doc_id", risk.label_is_suspicious(F.col("text")).alias("bad"))


TRUTH = """CASE WHEN contains(s, 'many') AND contains(s, 'to') AND contains(s, 'one') OR contains(s, 'fan') AND contains(s, 'in') AND contains(s, 'aggregat') THEN 'many-to-one collection'
WHEN contains(s, 'bridge') OR contains(s, 'cross') AND contains(s, 'chain') THEN 'cross-chain bridge hop'
WHEN contains(s, 'fan') AND contains(s, 'out') OR contains(s, 'dispersal') THEN 'fan-out'
WHEN contains(s, 'circular') OR contains(s, 'round') AND contains(s, 'trip') OR contains(s, 'loop') THEN 'circular loop / round-tripping'
WHEN contains(s, 'reconsolid') OR contains(s, 're-consolid') THEN 'reconsolidation'
WHEN contains(s, 'offramp') OR contains(s, 'off-ramp') OR contains(s, 'off') AND contains(s, 'exit') AND contains(s, 'ramp') THEN 'offramp exits'
WHEN contains(s, 'peel') THEN 'peel chain' WHEN contains(s, 'layer') THEN 'layering' END"""


@query("sca9", select(S(doc_id="doc_id", label=TRUTH), tail="FROM (SELECT doc_id, lower(text) AS s FROM documents)"))
def sca9(spark, d):
    """Whole document texts as analyst labels."""
    return table(spark, d, "documents").select("doc_id", normalise_truth(F.col("text")).alias("label"))


@query("sca11", select(S(part=f"coalesce({TRUTH.replace('s,', 'lower(p_type),')}, {TRUTH.replace('s,', 'lower(p_name),')}, 'none')"), I(n="count(*)"), tail="FROM part GROUP BY 1"))
def sca11(spark, d):
    """The first mappable value among columns whose names mark ground truth; other columns are ignored."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("AML Pattern"), F.col("p_name").alias("typology_hint"))
    return p.groupBy(F.coalesce(truth_label(p.columns), F.lit("none")).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("sca12", select(S(l_orderkey="l_orderkey", l_linenumber="CAST(l_linenumber AS BIGINT)"), D(seconds="max(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6)"), tail="FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"))
def sca12(spark, d):
    """Absolute distance between order and shipping time."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ts = [F.col(c).cast("timestamp") for c in ("l_shipdate", "o_orderdate")]
    return j.groupBy("l_orderkey", "l_linenumber").agg(F.max(scalars.seconds_between(*ts)).alias("seconds"))


@query("sca13", select(S(transaction_id="transaction_id", tier="CASE WHEN ord % 3 = 0 THEN 'tier2' WHEN ord % 2 = 0 THEN 'tier1' ELSE 'tier0' END"), tail="FROM tx_a"))
def sca13(spark, d):
    tier = risk.coverage_tier(F.lit(True), F.col("ord") % 2 == 0, F.col("ord") % 3 == 0)
    return transfers(spark, d).select("transaction_id", tier.alias("tier"))


@query("sca14", select(S(transaction_id="transaction_id", stage="CASE WHEN ord % 10 / 10.0 > 0.5 THEN 'integration' WHEN ord % 9 / 9.0 > 0.5 THEN 'layering' WHEN ord % 8 / 8.0 > 0.5 THEN 'placement' END"), tail="FROM tx_a"))
def sca14(spark, d):
    o = F.col("ord")
    return transfers(spark, d).select("transaction_id", risk.laundering_stage(o % 10 / 10.0, o % 9 / 9.0, o % 8 / 8.0).alias("stage"))


@query("sca16", sql("""SELECT page_id, md5(replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\', '\\\\')) AS clean,
CAST(length(replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\', '\\\\')) AS BIGINT) AS n FROM pages"""))
def sca16(spark, d):
    """Sanitised page texts."""
    clean = text.sanitise(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(clean).alias("clean"), F.length(clean).alias("n"))


@query("sca18", select(D(psi="sum((c - r) * ln(c / r))"), tail="""FROM (SELECT (count(*) FILTER (ord % 2 = 1) + 1.0::DOUBLE) / (SELECT count(*) FROM tx_a) AS c,
(count(*) FILTER (ord % 2 = 0) + 1.0::DOUBLE) / (SELECT count(*) FROM tx_a) AS r FROM tx_a GROUP BY asset_type)"""))
def sca18(spark, d):
    """Stability index of the asset mix between odd and even rows."""
    t = transfers(spark, d)
    n = t.agg(F.count(F.lit(1))).scalar()
    c = (F.count_if(F.col("ord") % 2 == 1) + 1.0) / n
    r = (F.count_if(F.col("ord") % 2 == 0) + 1.0) / n
    by = t.groupBy("asset_type").agg(c.alias("c"), r.alias("r"))
    return by.agg(F.sum(scalars.psi_term(F.col("c"), F.col("r"))).alias("psi"))


@query("sca19", select(S(transaction_id="transaction_id", ids="CASE WHEN ord % 5 = 0 OR ord % 5 = 1 OR ord % 5 = 2 THEN '' ELSE concat(ord % 185, ',', ord % 7) END"), tail="FROM tx_a"))
def sca19(spark, d):
    """Stored id lists, some missing, blank or damaged."""
    o = F.col("ord")
    raw = F.when(o % 5 == 0, None).when(o % 5 == 1, "  ").when(o % 5 == 2, "not json").otherwise(F.format_string(" [%d, %d] ", o % 185, o % 7))
    return transfers(spark, d).select("transaction_id", F.array_join(text.parse_id_list(raw), ",").alias("ids"))


@query("sca20", select(S(vec_id="vec_id"), T(timestamp="TIMESTAMP '2019-01-01' + to_hours(CAST(vec_id % 49 AS BIGINT))"), D(amount="round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 4)"), tail="FROM embeddings"))
def sca20(spark, d):
    """Sum of absolute features and hourly time per vector."""
    total = F.aggregate(F.transform("embedding", lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", hourly_time(F.col("vec_id") % 49).alias("timestamp"), F.round(total, 4).alias("amount"))


@query("fil7", select(S(transaction_id="transaction_id"), D(amount="amount", fee="coalesce(fee, 0)", absent="0", asset_type="0"), tail="FROM tx_a"))
def fil7(spark, d):
    """Fixed feature order with an absent and a non-numeric column."""
    return fixed_columns(transfers(spark, d), ["amount", "fee", "absent", "asset_type"], ["transaction_id"])


@query("set5", sql("SELECT sender_wallet, array_to_string(list_sort(list(DISTINCT asset_type)), ',') AS kinds FROM tx_a GROUP BY 1"))
def set5(spark, d):
    """Distinct sorted badge labels per wallet."""
    one = transfers(spark, d).select("sender_wallet", "asset_type").distinct()
    return one.groupBy("sender_wallet").agg(F.array_join(F.array_sort(F.collect_set("asset_type")), ",").alias("kinds"))
