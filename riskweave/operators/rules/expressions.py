"""Logic of the 48 rules over the wallet context (see ``engine.wallet_context`` for its columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Rule

# Amounts a threshold-avoiding wallet stays just below.
AVOIDED_AMOUNTS = [1000, 3000, 10000, 15000, 50000]


def _n(name: str) -> Column:
    """A numeric context column; the context has already turned absent values into 0."""
    return F.col(name)


def _b(name: str) -> Column:
    """A flag of the context; absent flags are already false."""
    return F.col(name)


def _cap(x: Column, top: float = 1.0) -> Column:
    return F.least(x, F.lit(top))


def _rule(when: Column, confidence: Column | float, applicable: Column | None = None) -> Rule:
    return Rule(when, confidence if isinstance(confidence, Column) else F.lit(float(confidence)), applicable)


def sub_threshold(below: Column, total: Column) -> tuple[Column, Column]:
    """RF1: share of amounts below a reporting threshold."""
    ratio = F.when(total > 0, below / total).otherwise(0.0)
    return (ratio > 0.7) & (below >= 3), ratio


def rapid_movement() -> tuple[Column, Column]:
    """RF2: retained balance small against the average amount."""
    ratio = F.when(_n("avg_amount") != 0, _n("balance") / _n("avg_amount"))
    return F.coalesce(ratio < 0.1, F.lit(False)), 1.0 - F.coalesce(ratio, F.lit(1.0))


def ego_cycle(limit: int) -> tuple[Column, Column]:
    """RF3: cycles of up to ``limit`` wallets through the wallet."""
    n = _n(f"n{limit}")
    return n > 0, n


def many_in(k: int) -> Column:
    """RF4."""
    return _n("in_degree") >= k


def many_out(k: int) -> Column:
    """RF5."""
    return _n("out_degree") >= k


def risky_tag() -> Column:
    """RF6."""
    return _b("tag_risky")


def fresh_high_value(days: int, amount: float) -> Column:
    """RF7: young wallet with volume; the age counts whole days up to ``as_of``."""
    return (_n("age_days") <= days) & F.col("age_days").isNotNull() & (_n("total_in") + _n("total_out") >= amount)


def mule() -> tuple[Column, Column]:
    """RF8: most of what comes in goes out."""
    ratio = F.when(_n("total_in") != 0, _n("total_out") / _n("total_in")).otherwise(0.0)
    return ratio > 0.9, ratio


def no_rationale() -> tuple[Column, Column]:
    """RF9: relaying without a matching number of counterparties."""
    score = _n("relay_pattern_score") / (_n("unique_counterparties") + 1)
    return score > 0.5, score


def tainted() -> tuple[Column, Column]:
    """RF10: risky neighbours, doubled near an exchange."""
    score = _n("suspicious_neighbor_ratio_1hop") * F.when(_b("near_exchange"), 2.0).otherwise(1.0)
    return score > 0.5, _cap(score)


def standard_rules() -> dict[int, Rule]:
    in_d, out_d, amounts = _n("in_degree"), _n("out_degree"), _n("tx_count")
    in_graph = _b("in_graph")
    mule_hit, mule_ratio = mule()
    taint_hit, taint = tainted()
    vague_hit, vague = no_rationale()
    rapid_hit, rapid = rapid_movement()
    c3, n3 = ego_cycle(3)
    c4, n4 = ego_cycle(4)
    c5, n5 = ego_cycle(5)
    c6, n6 = ego_cycle(6)
    cash_hit, cash = sub_threshold(_n("n_below_10000"), amounts)
    ach_hit, ach = sub_threshold(_n("n_below_3000"), amounts)
    recent = _n("recent_n") > 0
    split_hit, split = sub_threshold(
        F.when(recent, _n("recent_below_10000")).otherwise(_n("n_below_10000")),
        F.when(recent, _n("recent_n")).otherwise(amounts),
    )
    round_share = F.when(amounts > 0, _n("n_round_100") / amounts).otherwise(0.0)
    peel = F.when(_n("peel_edges") >= 3, _n("peel_drops") / (_n("peel_edges") - 1)).otherwise(0.0)
    volume = _n("total_in") + _n("total_out")
    dust = F.when(_n("inflow_n") > 0, _n("dust_n") / _n("inflow_n")).otherwise(0.0)
    cv = F.when(_n("interval_mean") != 0, _n("interval_std") / _n("interval_mean"))
    regular = _n("interval_n")
    band = F.greatest(*[_n(f"band_{t}") for t in AVOIDED_AMOUNTS])
    band_share = F.when(_n("recent_n") > 0, band / _n("recent_n")).otherwise(0.0)
    spread = F.when(_n("recent_mean") != 0, _n("recent_var") / (_n("recent_mean") * _n("recent_mean"))).otherwise(0.0)
    coin = _n("coinjoin_tx_count")
    wash, selfs = _n("nft_wash_trade_score"), _n("nft_self_trade_count")
    dodge = F.when(_n("neighbour_n") > 0, 1.0 - _n("screened_overlap") / _n("neighbour_n")).otherwise(1.0)
    sync, size, members = _n("temporal_sync_score"), _n("synchronized_cluster_size"), _n("unique_role_count")
    hop_n, hop_mean, hop_min = _n("chain_hop_n"), _n("chain_hop_mean"), _n("chain_hop_min")
    drift = F.abs(_n("pre_review_risk_score") - _n("post_review_risk_score"))
    shift = _n("behavior_shift_after_review")
    own = _n("same_cluster_edges")

    def score_rule(name: str, limit: float) -> Rule:
        return _rule(_n(name) > limit, _cap(_n(name)))

    return {
        1: _rule(cash_hit, cash),
        4: _rule(many_in(10), _cap(in_d / 20)),
        5: _rule((round_share > 0.6) & (_n("n_round_100") >= 3), round_share),
        6: _rule(rapid_hit, _cap(rapid)),
        17: _rule(c4, _cap(n4 / 5), in_graph),
        21: _rule(many_in(8) & many_out(8), _cap((in_d + out_d) / 40)),
        22: _rule(many_in(10), _cap(_cap(in_d / 20) + F.when(mule_hit, 0.2).otherwise(0.0))),
        23: _rule(mule_hit, _cap(mule_ratio)),
        26: _rule(c3, _cap(n3 / 3), in_graph),
        31: _rule((_n("dormancy_days") > 180) & (volume > 10000), _cap(_n("dormancy_days") / 730)),
        35: _rule(ach_hit, ach),
        91: _rule(peel > 0.7, peel),
        92: _rule(many_out(5), _cap(out_d / 30)),
        93: _rule(many_in(5), _cap(in_d / 30)),
        94: _rule(fresh_high_value(7, 1000), F.when(mule_hit, 0.9).otherwise(0.6)),
        95: _rule((_n("inflow_n") >= 5) & (dust > 0.5) & (_n("dust_n") >= 5), dust),
        96: _rule(own >= 3, _cap(own / 10)),
        97: _rule(
            (_n("unique_recipient_addresses_24h") >= 10) & (_n("new_address_ratio") > 0.8),
            _cap(_n("new_address_ratio") * _n("unique_recipient_addresses_24h") / 20),
        ),
        98: _rule(F.coalesce((regular >= 3) & (cv < 0.2), F.lit(False)), F.greatest(1 - cv, F.lit(0.0))),
        99: _rule(split_hit, split),
        100: _rule(
            many_in(8) & ((_n("young_ratio") > 0.5) | many_in(15)), _cap(in_d / 20 + 0.3 * _n("young_ratio"))
        ),
        101: score_rule("change_address_reuse_ratio", 0.7),
        102: _rule(coin > 0, _cap(coin / 5)),
        105: _rule(c6, _cap(n6 / 5), in_graph),
        132: _rule((wash > 0.6) | (selfs >= 3), F.greatest(wash, _cap(selfs / 5))),
        133: score_rule("nft_royalty_self_ratio", 0.5),
        134: score_rule("token_pump_score", 0.6),
        135: score_rule("sybil_cluster_score", 0.5),
        136: _rule(_n("stablecoin_mint_redeem_cycles") >= 3, _cap(_n("stablecoin_mint_redeem_cycles") / 6)),
        141: _rule(mule_hit & risky_tag(), _cap(1.2 * mule_ratio)),
        142: score_rule("nested_vasp_exposure_score", 0.4),
        144: _rule(taint_hit, taint),
        149: score_rule("cross_exchange_arb_score", 0.5),
        161: _rule(F.coalesce((regular >= 5) & (cv < 0.05), F.lit(False)), F.greatest(1 - 10 * cv, F.lit(0.0))),
        162: _rule((band_share > 0.4) & (spread > 0.01), _cap(1.5 * band_share)),
        163: _rule(
            _b("screening_known") & in_graph & (dodge > 0.95) & (_n("neighbour_n") >= 5)
            & (_n("avg_path_length_to_exchange") > 4),
            dodge,
        ),
        164: _rule((sync > 0.7) & (size >= 5), _cap(sync * size / 10)),
        165: _rule(
            (hop_n >= 2) & (hop_min < 5) & (hop_mean < 30) & (_n("chains_touched") >= 2),
            _cap((1 / F.greatest(hop_mean, F.lit(0.1))) * 5 * _n("chains_touched") / 3),
        ),
        172: _rule((drift > 0.3) & (shift > 0.5), _cap(drift + 0.5 * shift)),
        175: _rule((sync > 0.5) & (members >= 3) & vague_hit, _cap(0.4 * sync + 0.3 * members / 6 + 0.3 * vague)),
        176: _rule(_b("tag_sanctioned"), 0.9),
        179: _rule(_b("tag_ransomware"), F.greatest(F.lit(0.8), taint)),
        180: _rule(_b("tag_scam"), _cap(0.8 + F.when(many_in(15), in_d / 50).otherwise(0.0))),
        181: _rule(_b("tag_darknet"), 0.85),
        182: _rule(_b("csam_flagged"), 0.95),
        183: _rule(c5 & mule_hit, _cap(0.7 + 0.1 * n5), in_graph),
        184: _rule(risky_tag() & vague_hit, _cap(vague + 0.3)),
        185: _rule(mule_hit, _cap(_cap(mule_ratio) + F.when(risky_tag(), 0.2).otherwise(0.0))),
    }
