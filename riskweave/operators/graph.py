"""Wallet digraph: edges, nodes, local metrics, neighbour statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..session import cut_lineage


def real_pair(src: str = "sender_wallet", dst: str = "receiver_wallet") -> Column:
    """Both ends present, non-empty and different."""
    s, d = F.col(src), F.col(dst)
    return s.isNotNull() & d.isNotNull() & (s != "") & (d != "") & (s != d)


def wallet_edges(tx: DataFrame, order: str = "ord") -> DataFrame:
    """AGG1: one edge per ordered wallet pair: summed amount, latest time, attributes of the last row."""
    rows = tx.where(real_pair())
    amount = F.coalesce(F.nanvl(F.col("amount"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(F.col("sender_wallet").alias("src"), F.col("receiver_wallet").alias("dst")).agg(
        F.sum(amount).alias("amount"),
        F.max("timestamp").alias("timestamp"),
        F.count(F.lit(1)).alias("n_tx"),
        F.max_by("transaction_id", order).alias("transaction_id"),
        F.max_by("asset_type", order).alias("asset_type"),
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    """AGG2: endpoints of the edges."""
    return edges.select(F.col("src").alias("wallet")).union(edges.select("dst")).distinct()


def transaction_graph(tx: DataFrame, links: DataFrame, order: str = "ord") -> dict[str, DataFrame]:
    """AGG3: graph over transaction ids; self links stay, a repeated link keeps its last attributes."""
    attrs = [c for c in links.columns if c not in ("src", "dst", order)]
    edges = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_links"), *[F.max_by(c, order).alias(c) for c in attrs])
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    last = tx.groupBy(F.col("transaction_id").alias("id")).agg(
        F.max_by("amount", "ord").alias("amount"), F.max_by("label", "ord").alias("label")
    )
    return {"vertices": ids.join(last, "id", "full_outer"), "edges": edges}


def node_metrics(edges: DataFrame) -> DataFrame:
    """AGG4: degrees, weighted flows, volume and balance ratio per node, in one shuffle."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("src").alias("wallet"), F.lit(0).alias("i"), F.lit(1).alias("o"),
                    F.lit(0.0).alias("win"), F.col("amount").alias("wout"),
                ),
                F.struct(
                    F.col("dst").alias("wallet"), F.lit(1).alias("i"), F.lit(0).alias("o"),
                    F.col("amount").alias("win"), F.lit(0.0).alias("wout"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    m = ends.groupBy("wallet").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"),
        F.sum("win").alias("weighted_in"), F.sum("wout").alias("weighted_out"),
    )
    total = F.col("weighted_in") + F.col("weighted_out")
    return m.withColumns(
        {
            "total_volume": total,
            "balance_ratio": F.when(total != 0, (F.col("weighted_in") - F.col("weighted_out")) / total).otherwise(0.0),
        }
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs, both directions."""
    return edges.select(F.col("src").alias("wallet"), F.col("dst").alias("nb")).union(edges.select("dst", "src")).distinct()


def wallet_totals(tx: DataFrame) -> DataFrame:
    """AGG5: first and last seen, totals in and out over both roles; self-transfers count."""
    return roles(tx).groupBy("wallet").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.sum("received").alias("total_in"),
        F.sum("sent").alias("total_out"),
    )


def roles(tx: DataFrame, *extra: str) -> DataFrame:
    """Each transfer twice: once for its sender, once for its receiver."""
    cols = ["timestamp", "amount", *extra]
    return tx.select(
        *cols,
        F.explode(
            F.array(
                F.struct(F.col("sender_wallet").alias("wallet"), F.col("amount").alias("sent"), F.lit(0.0).alias("received")),
                F.struct(F.col("receiver_wallet").alias("wallet"), F.lit(0.0).alias("sent"), F.col("amount").alias("received")),
            )
        ).alias("r"),
    ).select(*cols, "r.*").where(F.col("wallet").isNotNull() & (F.col("wallet") != ""))


def wallet_profiles(tx: DataFrame, metrics: DataFrame) -> DataFrame:
    """AGG6: the rule inputs per wallet.

    The amount list a rule would scan is reduced to the counts the rules ask for,
    so a wallet with very many transfers never becomes one huge array.
    """
    a = F.col("amount")

    def share(low: float, high: float) -> Column:
        return F.count_if((a >= low) & (a < high))

    p = roles(tx).groupBy("wallet").agg(
        F.sum("received").alias("total_in"),
        F.sum("sent").alias("total_out"),
        F.count(F.lit(1)).alias("tx_count"),
        F.count_if((a > 0) & (a < 10000)).alias("n_below_10000"),
        F.count_if((a > 0) & (a < 3000)).alias("n_below_3000"),
        F.count_if((a != 0) & (a % 100 == 0)).alias("n_round_100"),
        F.avg("amount").alias("avg_amount"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    deg = metrics.select("wallet", "in_degree", "out_degree", F.lit(True).alias("in_graph"))
    p = p.join(deg, "wallet", "left").na.fill({"in_degree": 0, "out_degree": 0, "in_graph": False})
    return p.withColumns(
        {
            "pass_through": F.when(F.col("total_in") > 0, F.col("total_out") / F.col("total_in")).otherwise(0.0),
            "balance": F.greatest(F.col("total_in") - F.col("total_out"), F.lit(0.0)),
        }
    )


def inbound_counterparties(edges: DataFrame) -> DataFrame:
    """AGG7: inbound counterparties per wallet, one row each rather than one list per wallet."""
    return edges.select(F.col("dst").alias("wallet"), F.col("src").alias("deposit_from"))


def structural_features(metrics: DataFrame, nb: DataFrame) -> DataFrame:
    """AGG8 + AGG11: fan ratios, distinct counterparties and the relay score scaled by its global maximum."""
    d = F.col("in_degree") + F.col("out_degree") + 1
    cp = nb.groupBy("wallet").agg(F.count(F.lit(1)).alias("unique_counterparties"))
    f = metrics.join(cp, "wallet").withColumns(
        {
            "fan_in_ratio": F.col("in_degree") / d,
            "fan_out_ratio": F.col("out_degree") / d,
            "relay_raw": F.col("in_degree") * F.col("out_degree") / (F.col("total_volume") + 1.0),
        }
    )
    top = relay_maximum(metrics)
    return f.withColumn("relay_pattern_score", F.when(top > 0, F.col("relay_raw") / top).otherwise(0.0)).drop("relay_raw")


def relay_maximum(metrics: DataFrame) -> Column:
    """Largest raw relay score as a scalar subquery."""
    raw = F.col("in_degree") * F.col("out_degree") / (F.col("total_volume") + 1.0)
    return metrics.agg(F.max(raw)).scalar()


def risky_nodes(pagerank: DataFrame, threshold: float = DEFAULTS.risky_pagerank) -> DataFrame:
    """Nodes above the PageRank threshold. Ranks sum to 1, so fewer than ``1/threshold`` rows are broadcast."""
    return F.broadcast(pagerank.where(F.col("pagerank") > threshold).select(F.col("wallet").alias("risky")))


def risky_direct_share(nb: DataFrame, risky: DataFrame) -> DataFrame:
    """AGG9: share of risky wallets among the direct neighbours."""
    known = nb.join(risky, nb.nb == risky.risky, "left")
    return known.groupBy("wallet").agg((F.count("risky") / F.count(F.lit(1))).alias("suspicious_neighbor_ratio_1hop"))


def risky_neighbour_shares(nb: DataFrame, risky: DataFrame) -> DataFrame:
    """AGG9 + AGG10: share of risky wallets among 1-hop and 2-hop neighbours.

    The numerators only walk outward from the risky wallets. The 2-hop
    denominator is the number of distinct wallets two steps away.
    """
    one = nb.groupBy("wallet").agg(F.count(F.lit(1)).alias("n1"))
    hit1 = nb.join(risky, nb.nb == risky.risky).groupBy("wallet").agg(F.count(F.lit(1)).alias("k1"))
    # walk risky -> neighbour -> neighbour: the relation is symmetric
    step = nb.join(risky, nb.wallet == risky.risky).select(F.col("nb").alias("mid"), "risky")
    hit2 = (
        step.join(nb, step.mid == nb.wallet).where(F.col("nb") != F.col("risky"))
        .select(F.col("nb").alias("wallet"), "risky").distinct()
        .groupBy("wallet").agg(F.count(F.lit(1)).alias("k2"))
    )
    out = one.join(hit1, "wallet", "left").join(hit2, "wallet", "left")
    if risky.isEmpty():
        return out.select(
            "wallet",
            F.lit(0.0).alias("suspicious_neighbor_ratio_1hop"),
            F.lit(0.0).alias("suspicious_neighbor_ratio_2hop"),
        )
    touched = hit2.select("wallet")
    two = two_hop_counts(nb, touched)
    return out.join(two, "wallet", "left").select(
        "wallet",
        (F.coalesce("k1", F.lit(0)) / F.col("n1")).alias("suspicious_neighbor_ratio_1hop"),
        F.when(F.col("n2") > 0, F.coalesce("k2", F.lit(0)) / F.col("n2")).otherwise(0.0)
        .alias("suspicious_neighbor_ratio_2hop"),
    )


def two_hop_counts(nb: DataFrame, wallets: DataFrame, hub_degree: int = 10_000, most_reach: int = 1_000_000) -> DataFrame:
    """Distinct wallets two steps away (not the wallet itself), for the wallets that need the count.

    Walking through a hub would emit every pair of its neighbours. Ordinary wallets tell all their neighbours the whole
    list of them, and lists are put together per wallet inside tasks; the wallets reachable through hubs are counted
    once per distinct set of adjacent hubs, and listed wallets already covered by a
    shared hub are left out. A wallet that is told more than ``most_reach`` others is dealt over several tasks by the wallets reached.
    The result is the same at any ``hub_degree`` and ``most_reach``.
    """
    ids, n = _numbered(nb.select("wallet"))
    links = nb.join(ids, "wallet").select(F.col("id").alias("w"), "nb")
    links = cut_lineage(links.join(ids.select(F.col("wallet").alias("nb"), F.col("id").alias("u")), "nb").select("w", "u"))
    asked = cut_lineage(ids.join(wallets, "wallet", "left_semi").select(F.col("id").alias("w")))
    hubs = cut_lineage(links.groupBy("w").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > hub_degree).select("w"))
    has_hubs = not hubs.isEmpty()
    none = F.array().cast(f"array<{links.schema['w'].dataType.simpleString()}>")
    if has_hubs:
        beside = links.join(hubs, "w", "left_semi").select(F.col("u").alias("w"), F.col("w").alias("hub"))
        sets = cut_lineage(beside.groupBy("w").agg(F.array_sort(F.collect_set("hub")).alias("hubs")))
        known = links.join(hubs, "w", "left_anti").join(sets.select(F.col("w").alias("u"), "hubs"), "u", "left")
        lists = known.groupBy("w").agg(F.collect_list("u").alias("near"), F.collect_list(F.when(F.col("hubs").isNotNull(), F.struct("u", "hubs"))).alias("at"))
    else:
        lists = links.groupBy("w").agg(F.collect_list("u").alias("near")).withColumn("at", F.array())
    lists = lists.select("near", "at")
    reach = lists.select(F.size("near").alias("k"), F.explode("near").alias("w")).groupBy("w").agg(F.sum("k").alias("k"))
    wide = cut_lineage(reach.where(F.col("k") > most_reach).select("w", F.ceil(F.col("k") / most_reach).cast("int").alias("slices")))
    told = lists.select(F.explode("near").alias("w"), "near", "at").join(asked, "w", "left_semi")
    if not wide.isEmpty():
        cut = told.join(wide, "w").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        cut = cut.withColumn("near", F.filter("near", lambda u: u % F.col("slices") == F.col("slice")))
        if has_hubs:
            cut = cut.withColumn("at", F.filter("at", lambda x: x["u"] % F.col("slices") == F.col("slice")))
        cut = cut.where(F.size("near") > 0).select("w", "slice", "near", "at")
        told = told.join(wide, "w", "left_anti").select("w", F.lit(0).alias("slice"), "near", "at").unionByName(cut)
    else:
        told = told.select("w", F.lit(0).alias("slice"), "near", "at")
    if has_hubs:
        told = told.select(
            "w", "slice", "near", F.flatten(F.transform("at", lambda x: F.array_repeat(x["u"], F.size(x["hubs"])))).alias("far"),
            F.flatten(F.transform("at", lambda x: x["hubs"])).alias("hub"), none.alias("own"),
        )
        own = sets.join(asked, "w", "left_semi").join(wide, "w", "left")
        own = own.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
        told = told.unionByName(own.select("w", "slice", none.alias("near"), none.alias("far"), none.alias("hub"), F.col("hubs").alias("own")))
    else:
        told = told.select("w", "slice", "near", none.alias("far"), none.alias("hub"), none.alias("own"))
    dealt = told.repartition("w", "slice").sortWithinPartitions("w", "slice")
    new = dealt.mapInArrow(_distinct_reached(n), "w long, by_lists long").groupBy("w").agg(F.sum("by_lists").alias("by_lists"))
    n2 = F.col("by_lists")
    seen = new
    if has_hubs:
        seen = asked.join(sets, "w", "left").join(_covered(links, hubs, sets.join(asked, "w", "left_semi")), "hubs", "left").join(new, "w", "left")
        n2 = F.coalesce("by_hubs", F.lit(0)) + F.coalesce("by_lists", F.lit(0))
    return seen.select(F.col("w").alias("id"), n2.alias("n2")).where(F.col("n2") > 0).join(ids, "id").select("wallet", "n2")


def _numbered(wallets: DataFrame) -> tuple[DataFrame, int]:
    """Wallets with gapless numbers from 0 as ``id``, and how many there are. One count per partition comes to the driver."""
    found = cut_lineage(wallets.where(F.col("wallet").isNotNull()).distinct().withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    total, first = 0, []
    for r in found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        first += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    start = F.create_map(*first)[part] if first else F.lit(0)
    return found.select("wallet", (start + row).cast("int" if total < 1 << 31 else "bigint").alias("id")), total


def _covered(links: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hubs, by_hubs): wallets beside any hub of a set, less the one that asks. A single hub has as many as it has neighbours."""
    around = links.join(hubs, "w", "left_semi").select(F.col("w").alias("hub"), F.col("u").alias("far"))
    kinds = cut_lineage(sets.select("hubs").distinct().withColumn("kind", F.monotonically_increasing_id()))
    one = kinds.where(F.size("hubs") == 1).select("kind", F.col("hubs")[0].alias("hub"))
    one = one.join(around.groupBy("hub").agg(F.countDistinct("far").alias("c")), "hub").select("kind", "c")
    more = kinds.where(F.size("hubs") > 1).select("kind", F.explode("hubs").alias("hub")).join(around, "hub")
    more = more.select("kind", "far").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("c"))
    return kinds.join(one.unionByName(more), "kind").select("hubs", (F.col("c") - 1).alias("by_hubs"))


def _distinct_reached(n: int):
    """Counts, per (w, slice), the distinct wallets of ``near`` that are not ``w`` and share no hub with it; rows come ordered."""

    def flat(column: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(group, column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def counted(rows: pa.RecordBatch) -> pa.RecordBatch:
        w, part = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "slice"))
        begins = np.r_[True, (w[1:] != w[:-1]) | (part[1:] != part[:-1])]
        group, names = np.cumsum(begins) - 1, w[begins]
        g, near = flat(rows.column("near"), group)
        reached = np.unique(g * n + near)
        reached = reached[reached % n != names[reached // n]]
        g, far = flat(rows.column("far"), group)
        hub, (o, own) = rows.column("hub").flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat(rows.column("own"), group)
        if len(own) and len(far):
            reached = np.setdiff1d(reached, (g * n + far)[np.isin(g * n + hub, o * n + own)], assume_unique=False)
        count = np.bincount(reached // n, minlength=len(names))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(count, pa.int64())], names=["w", "by_lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last group, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            w, part = b.column("w").to_numpy(zero_copy_only=False), b.column("slice").to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (part[1:] != part[:-1])])[-1])
            if held and not last and (held[0].column("w")[0].as_py(), held[0].column("slice")[0].as_py()) == (w[0], part[0]):
                held.append(b)
                continue
            done = pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks().to_batches()
            yield from (counted(rows) for rows in done if rows.num_rows)
            held = [b.slice(last)]
        for rows in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield counted(rows)

    return run


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in ``members(wallet)``."""
    m = members.select("wallet").distinct()
    e = edges.join(m.withColumnRenamed("wallet", "src"), "src", "left_semi")
    return e.join(m.withColumnRenamed("wallet", "dst"), "dst", "left_semi").select(*edges.columns)
