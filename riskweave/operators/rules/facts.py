"""What a fired rule saw, in words: the counts and ratios of the wallet context that made it fire."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column | str) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("bigint"), F.lit(0).cast("bigint"))


def _hundredths(x: Column | str) -> Column:
    """Rounded before it is written; halves go up, whatever the last bits of a quotient are."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") + 1e-9, 2)


def _said(text: str, *values: Column | str) -> Column:
    """``text`` with ``{n}`` for whole numbers and ``{r}`` for numbers with two decimals, filled in turn."""
    kinds = [part[0] for part in text.split("{")[1:]]
    put = [_whole(v) if k == "n" else _hundredths(v) for k, v in zip(kinds, values, strict=True)]
    return F.format_string(text.replace("{n}", "%d").replace("{r}", "%.2f"), *put)


def standard_facts() -> dict[int, Column]:
    volume = F.col("total_in") + F.col("total_out")
    passed = F.col("total_out") / F.col("total_in")
    recent = F.col("recent_n") > 0
    kept = F.when(F.col("avg_amount") != 0, F.col("balance") / F.col("avg_amount"))
    spread = F.when(F.col("interval_mean") != 0, F.col("interval_std") / F.col("interval_mean"))
    relay = F.col("relay_pattern_score") / (F.col("unique_counterparties") + 1)
    avoided = F.greatest(*[F.col(f"band_{t}") for t in (1000, 3000, 10000, 15000, 50000)])
    cycles = "{n} payment cycles of up to %s wallets"
    tag = "counterparty or wallet tagged as %s"
    return {
        1: _said("{n} of {n} amounts are below 10000", "n_below_10000", "tx_count"),
        4: _said("{n} different payers", "in_degree"),
        5: _said("{n} of {n} amounts are round hundreds", "n_round_100", "tx_count"),
        6: _said("{r} of an average amount is kept", kept),
        17: _said(cycles % "four", "n4"),
        21: _said("{n} payers and {n} payees", "in_degree", "out_degree"),
        22: _said("{n} payers, {r} of the inflow goes out", "in_degree", F.coalesce(passed, F.lit(0.0))),
        23: _said("{r} of the inflow goes out", passed),
        26: _said(cycles % "three", "n3"),
        31: _said("{n} days without activity at a volume of {r}", "dormancy_days", volume),
        35: _said("{n} of {n} amounts are below 3000", "n_below_3000", "tx_count"),
        91: _said("{n} of {n} payments are smaller than the one before", "peel_drops", F.col("peel_edges") - 1),
        92: _said("{n} different payees", "out_degree"),
        93: _said("{n} different payers", "in_degree"),
        94: _said("{n} days old at a volume of {r}", "age_days", volume),
        95: _said("{n} of {n} receipts are dust", "dust_n", "inflow_n"),
        96: _said("{n} links inside its own community", "same_cluster_edges"),
        97: _said("{n} payees in the window, {r} of them new", "unique_recipient_addresses_24h", "new_address_ratio"),
        98: _said("{n} gaps between payments, spread {r} of their mean", "interval_n", spread),
        99: _said(
            "{n} of {n} amounts are below 10000", F.when(recent, F.col("recent_below_10000")).otherwise(F.col("n_below_10000")),
            F.when(recent, F.col("recent_n")).otherwise(F.col("tx_count")),
        ),
        100: _said("{n} payers, {r} of them young", "in_degree", "young_ratio"),
        101: _said("{r} of change addresses are used again", "change_address_reuse_ratio"),
        102: _said("{n} mixing transactions", "coinjoin_tx_count"),
        105: _said(cycles % "six", "n6"),
        132: _said("wash score {r}, {n} trades with itself", "nft_wash_trade_score", "nft_self_trade_count"),
        133: _said("{r} of royalties return to the payer", "nft_royalty_self_ratio"),
        134: _said("pump score {r}", "token_pump_score"),
        135: _said("twin-wallet score {r}", "sybil_cluster_score"),
        136: _said("{n} rounds of minting and redeeming", "stablecoin_mint_redeem_cycles"),
        141: _said("{r} of the inflow goes out, near risky tags", passed),
        142: _said("exposure {r} to nested services", "nested_vasp_exposure_score"),
        144: _said("{r} of the neighbours are risky", "suspicious_neighbor_ratio_1hop"),
        149: _said("score {r} for prices across exchanges", "cross_exchange_arb_score"),
        161: _said("{n} gaps between payments, spread {r} of their mean", "interval_n", spread),
        162: _said("{n} of {n} last payments just below a limit", avoided, "recent_n"),
        163: _said("{n} of {n} neighbours are screened, {n} steps to an exchange", "screened_overlap", "neighbour_n", "avg_path_length_to_exchange"),
        164: _said("{r} of payments in step with {n} others", "temporal_sync_score", "synchronized_cluster_size"),
        165: _said("{n} chain changes over {n} chains, {r} seconds on average", "chain_hop_n", "chains_touched", "chain_hop_mean"),
        172: _said("risk moved from {r} to {r} after review", "pre_review_risk_score", "post_review_risk_score"),
        175: _said("{r} of payments in step, {n} roles, relay score {r}", "temporal_sync_score", "unique_role_count", relay),
        176: F.lit(tag % "sanctioned"),
        179: F.lit(tag % "ransomware"),
        180: F.lit(tag % "scam"),
        181: F.lit(tag % "darknet"),
        182: F.lit("flagged by the caller's table"),
        183: _said(cycles % "five" + ", {r} of the inflow goes out", "n5", passed),
        184: _said("relay score {r} per counterparty, near risky tags", relay),
        185: _said("{r} of the inflow goes out", passed),
    }
