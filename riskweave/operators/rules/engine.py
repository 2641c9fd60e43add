"""Wallet context, rule vectors and per-transfer rule aggregates.

No rule reads the transfer itself, so the rules run once per wallet and the result
is joined to the transfers by sender.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...config import FIRED_EPS, N_RULES
from ..ordered import ordered_scan
from .facts import standard_facts
from .registry import RuleBook

# Context columns a caller's wallet table may supply; absent ones count as 0 / false.
OPTIONAL_NUMBERS = [
    "dormancy_days", "recent_n", "recent_below_10000", "recent_mean", "recent_var",
    "band_1000", "band_3000", "band_10000", "band_15000", "band_50000",
    "inflow_n", "dust_n", "interval_n", "interval_mean", "interval_std",
    "unique_recipient_addresses_24h", "new_address_ratio", "same_cluster_edges", "young_ratio",
    "change_address_reuse_ratio", "coinjoin_tx_count", "nft_wash_trade_score", "nft_self_trade_count",
    "nft_royalty_self_ratio", "token_pump_score", "sybil_cluster_score", "stablecoin_mint_redeem_cycles",
    "nested_vasp_exposure_score", "cross_exchange_arb_score", "neighbour_n", "screened_overlap",
    "avg_path_length_to_exchange", "temporal_sync_score", "synchronized_cluster_size", "unique_role_count",
    "chain_hop_n", "chain_hop_mean", "chain_hop_min", "chains_touched",
    "pre_review_risk_score", "post_review_risk_score", "behavior_shift_after_review",
]
OPTIONAL_FLAGS = [
    "tag_risky", "tag_sanctioned", "tag_ransomware", "tag_scam", "tag_darknet", "near_exchange", "csam_flagged",
    "screening_known",
]


def peel_edges(edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """WIN10: per wallet the number of outgoing edges and of drops in edge amount, in edge-time order."""
    s = ordered_scan(edges, ["src"], ["timestamp", "dst"], lag={"_pa": "amount"}, hot_rows=hot_rows)
    return s.groupBy(F.col("src").alias("wallet")).agg(
        F.count(F.lit(1)).alias("peel_edges"), F.count_if(F.col("amount") < F.col("_pa")).alias("peel_drops")
    )


PROFILE_COLUMNS = [
    "tx_count", "total_in", "total_out", "balance", "avg_amount", "n_below_10000", "n_below_3000", "n_round_100",
    "in_degree", "out_degree", "relay_pattern_score", "unique_counterparties", "suspicious_neighbor_ratio_1hop",
    "n3", "n4", "n5", "n6", "peel_edges", "peel_drops",
]


def wallet_context(
    profiles: DataFrame, *parts: DataFrame | None, as_of: Column | None = None, enrichment: DataFrame | None = None
) -> DataFrame:
    """All rule inputs per wallet; inputs no part supplies count as absent.

    Every part is keyed by wallet, so the joins share one partitioning.
    """
    ctx = profiles
    for part in (*parts, enrichment):
        if part is not None:
            ctx = ctx.join(part.select(*[c for c in part.columns if c == "wallet" or c not in ctx.columns]), "wallet", "left")
    now = F.current_timestamp() if as_of is None else as_of
    extra = {}
    if "first_seen" in ctx.columns:
        extra["age_days"] = F.floor((F.unix_micros(now) - F.unix_micros("first_seen")) / 86_400_000_000).cast("double")
    numbers = [*PROFILE_COLUMNS, *OPTIONAL_NUMBERS, "age_days"]
    extra.update({c: F.lit(None).cast("double") for c in numbers if c not in ctx.columns and c not in extra})
    extra.update({c: F.lit(None).cast("boolean") for c in [*OPTIONAL_FLAGS, "in_graph"] if c not in ctx.columns})
    flags = [*OPTIONAL_FLAGS, "in_graph"]
    return ctx.withColumns(extra).na.fill(0, [*PROFILE_COLUMNS, *OPTIONAL_NUMBERS]).na.fill(False, flags)


def confidences(ctx: DataFrame, ids, book: RuleBook | None = None) -> DataFrame:
    """Confidence of selected rules per wallet, one column ``c<id>`` each."""
    book = book or RuleBook.standard()
    return ctx.select("wallet", *[confidence(book, ctx, i).alias(f"c{i}") for i in ids])


def confidence(book: RuleBook, ctx: DataFrame, rule_id: int) -> Column:
    rule = book.logic[rule_id]
    return F.when(applicability(book, ctx, rule_id) & rule.when, rule.confidence).otherwise(0.0).cast("double")


def requirement_met(name: str, columns: list[str]) -> Column:
    """RUL0: an input is present; the profile supplies amounts, times and inbound counterparties."""
    if name in ("amount", "timestamp", "deposit_patterns"):
        return F.col("tx_count") > 0
    return F.col(name).isNotNull() if name in columns else F.lit(False)


def applicability(book: RuleBook, ctx: DataFrame, rule_id: int) -> Column:
    """RUL0: true when the rule's inputs exist and its own condition holds."""
    ok = F.lit(True)
    for need in book.info[rule_id].data_requirements:
        ok = ok & requirement_met(need, ctx.columns)
    rule = book.logic.get(rule_id)
    if rule is not None and rule.applicable is not None:
        ok = ok & rule.applicable
    return ok


def evaluate(ctx: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """RUL-V, RUL-E, TOP2: vectors, fired ids, top rules and explanations per wallet.

    An explanation names the rule, the fact that made it fire and the confidence.
    """
    book = book or RuleBook.standard()
    hits: dict[str, Column] = {}
    for i, rule in sorted(book.logic.items()):
        ok = applicability(book, ctx, i)
        hits[f"_c{i}"] = confidence(book, ctx, i)
        hits[f"_t{i}"] = ok & rule.when
        hits[f"_a{i}"] = ok
    out = ctx.withColumns(hits)
    ids = range(1, book.size() + 1)
    known = [i for i in ids if i in book.logic]
    missing = "inapplicable_missing_data"
    slots = [f"_c{i}" if i in book.logic else "0.0D" for i in ids]
    status = [
        f"if(_a{i}, 'applicable', '{missing}')" if i in book.logic else f"'{'applicable' if i in book.info else missing}'" for i in ids
    ]
    rules = [
        f"if(_t{i} OR _c{i} > {FIRED_EPS}D, named_struct('neg', -_c{i}, 'id', {i}, 'name', '{book.info[i].name}'), NULL)" for i in known
    ]
    out = out.withColumns(
        {
            "heuristic_vector": F.expr(f"array({', '.join(slots)})"),
            "applicability_vector": F.expr(f"array({', '.join(status)})"),
            "_f": F.array_compact(F.expr(f"array({', '.join(rules)})")),
        }
    )
    out = out.withColumn("_top", F.slice(F.array_sort("_f"), 1, 5))
    first = F.try_element_at("_top", F.lit(1))
    facts = standard_facts()
    told = [
        F.when(
            F.col(f"_t{i}") | (F.col(f"_c{i}") > FIRED_EPS),
            F.struct(
                F.lit(str(i)),
                F.format_string("%s: %s (confidence %.2f)", F.lit(book.info[i].name), facts.get(i, F.lit("its condition holds")), F.round(F.col(f"_c{i}") + 1e-9, 2)),
            ),
        )
        for i in known
    ]
    text = F.filter(F.array(*told), lambda x: x.isNotNull())
    return out.select(
        "wallet", "heuristic_vector", "applicability_vector",
        F.transform("_f", lambda x: x["id"]).alias("triggered_ids"),
        F.size("_f").alias("heuristic_triggered_count"),
        first["name"].alias("heuristic_top_typology"),
        (-first["neg"]).alias("heuristic_top_confidence"),
        F.transform("_top", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), (-x["neg"]).alias("confidence"))).alias("top_rules"),
        F.map_from_entries(text).alias("heuristic_explanations"),
    )


def rule_aggregates(vector: Column, top: Column) -> dict[str, Column]:
    """RUL-A: mean of non-zero confidences, maximum, number of non-zero ones, top and ratio."""
    positive = F.filter(vector, lambda x: x > 0)
    n = F.size(positive)
    total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    return {
        "heuristic_mean": F.when(n > 0, total / n).otherwise(0.0),
        "heuristic_max": F.array_max(vector),
        "heuristic_nonzero_count": n,
        "heuristic_top": F.coalesce(top, F.lit(0.0)),
        "heuristic_triggered_ratio": n / F.lit(N_RULES),
    }


def stored_ids(ids: Column, vector: Column) -> Column:
    """SET4: fired ids together with every slot above the noise level, sorted."""
    slots = F.filter(F.transform(vector, lambda x, i: F.when(x > FIRED_EPS, i + 1)), lambda x: x.isNotNull())
    return F.array_sort(F.array_union(F.coalesce(ids, F.array().cast("array<int>")), slots))
