"""Optional wallet inputs derived from transfers, tags and communities."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...config import DEFAULTS, Settings
from ...functions.risk import RISKY_TAGS
from ...functions.scalars import seconds_after
from ...session import cut_lineage
from ..cleaning import trailing_hours
from ..clusters import flow_roles
from ..graph import neighbours, roles
from ..ordered import ordered_scan
from ..tx_features import ORDER
from ..window24 import synchronised_sends
from .expressions import AVOIDED_AMOUNTS


def recent_sends(tx: DataFrame, n: int = 50) -> DataFrame:
    """Statistics of the last ``n`` sends; the row-number filter is applied before the shuffle as well."""
    w = Window.partitionBy("sender_wallet").orderBy(F.col("timestamp").desc(), F.col("ord").desc())
    last = tx.select("sender_wallet", "timestamp", "ord", "amount").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    a = F.col("amount")
    return last.groupBy(F.col("sender_wallet").alias("wallet")).agg(
        F.count(F.lit(1)).alias("recent_n"),
        F.count_if((a > 0) & (a < 10000)).alias("recent_below_10000"),
        F.avg("amount").alias("recent_mean"),
        F.var_pop("amount").alias("recent_var"),
        *[F.count_if((a >= 0.8 * t) & (a < t)).alias(f"band_{t}") for t in AVOIDED_AMOUNTS],
    )


def inflows(tx: DataFrame, dust: float = 0.001) -> DataFrame:
    return tx.groupBy(F.col("receiver_wallet").alias("wallet")).agg(
        F.count(F.lit(1)).alias("inflow_n"), F.count_if(F.col("amount") <= dust).alias("dust_n")
    )


def send_intervals(tx: DataFrame, hot_rows=None) -> DataFrame:
    """Number, mean and spread of the gaps between sends, and of the gaps across a chain change."""
    s = ordered_scan(tx, ["sender_wallet"], ORDER, lag={"_p": "timestamp", "_pc": "chain_id"}, hot_rows=hot_rows)
    gap = seconds_after("timestamp", "_p")
    hop = F.when(F.col("chain_id") != F.col("_pc"), gap)
    return s.groupBy(F.col("sender_wallet").alias("wallet")).agg(
        F.count(gap).alias("interval_n"), F.avg(gap).alias("interval_mean"), F.stddev_pop(gap).alias("interval_std"),
        F.count(hop).alias("chain_hop_n"), F.avg(hop).alias("chain_hop_mean"), F.min(hop).alias("chain_hop_min"),
        F.countDistinct("chain_id").alias("chains_touched"),
    )


def new_recipients(tx: DataFrame, hours: int = 24) -> DataFrame:
    """Distinct receivers in the trailing window and the share of them first used inside it."""
    first = tx.groupBy("sender_wallet", "receiver_wallet").agg(F.min("timestamp").alias("f"), F.max("timestamp").alias("l"))
    start = tx.agg(F.max("timestamp")).scalar() - F.expr(f"INTERVAL {hours} HOURS")
    return first.where(F.col("l") >= start).groupBy(F.col("sender_wallet").alias("wallet")).agg(
        F.count(F.lit(1)).alias("unique_recipient_addresses_24h"),
        F.avg((F.col("f") >= start).cast("double")).alias("new_address_ratio"),
    )


def dormancy(tx: DataFrame, hot_rows=None) -> DataFrame:
    """Longest pause between two activities, in days."""
    acts = roles(tx, "ord").select("wallet", "timestamp", "ord", F.when(F.col("sent") != 0, 0).otherwise(1).alias("side"))
    s = ordered_scan(acts, ["wallet"], ["timestamp", "ord", "side"], lag={"_p": "timestamp"}, hot_rows=hot_rows)
    return s.groupBy("wallet").agg((F.coalesce(F.max(seconds_after("timestamp", "_p")), F.lit(0.0)) / 86400).alias("dormancy_days"))


def cluster_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges to and from members of the wallet's own community."""
    s = partition.select(F.col("wallet").alias("src"), F.col("community").alias("cs"))
    d = partition.select(F.col("wallet").alias("dst"), F.col("community").alias("cd"))
    inner = edges.join(s, "src").join(d, "dst").where(F.col("cs") == F.col("cd"))
    return inner.select(F.explode(F.array("src", "dst")).alias("wallet")).groupBy("wallet").agg(F.count(F.lit(1)).alias("same_cluster_edges"))


def synchrony(tx: DataFrame, edges: DataFrame, partition: DataFrame, seconds: int = 60, hot_rows=None) -> DataFrame:
    """Share of synchronised sends, community size and number of flow roles in the community."""
    flags = synchronised_sends(tx, seconds, hot_rows)
    score = flags.groupBy(F.col("sender_wallet").alias("wallet")).agg(F.avg(F.col("synchronised").cast("double")).alias("temporal_sync_score"))
    kinds = flow_roles(edges, partition.select("wallet", F.col("community").alias("cluster_id")))
    per = kinds.groupBy("cluster_id").agg(F.countDistinct("role").alias("unique_role_count"), F.count(F.lit(1)).alias("synchronized_cluster_size"))
    who = partition.select("wallet", F.col("community").alias("cluster_id")).join(per, "cluster_id").drop("cluster_id")
    return who.join(score, "wallet", "left")


#: Tags that rules ask for by name; the other risky ones count together.
NAMED_TAGS = ("sanctioned", "ransomware", "scam", "darknet")


def _tags_at(sightings: DataFrame, tags: DataFrame, hot_rows: int | None) -> DataFrame:
    """``sightings(address, time, ...)`` of tagged addresses with the number of tags of each kind that hold there and then.

    Beginnings and ends of tags and the sightings are put in one order per address; running sums over the beginnings
    and ends are the tags that hold. So a tag costs two rows however many transfers meet it, and a busy address is scanned in pieces.
    """
    kinds = [*NAMED_TAGS, "other", "exchange"]
    kind = F.when(F.col("tag").isin(*NAMED_TAGS, "exchange"), F.col("tag")).otherwise("other")
    sound = F.col("valid_from").isNull() | F.col("valid_to").isNull() | (F.col("valid_from") <= F.col("valid_to"))
    t = tags.where(sound).select(F.col("wallet_address").alias("address"), kind.alias("kind"), "valid_from", "valid_to")
    begin = t.select("address", "kind", F.col("valid_from").alias("time"), F.lit(0).alias("side"), F.lit(1).cast("long").alias("d"))
    end = t.where(F.col("valid_to").isNotNull()).select("address", "kind", F.col("valid_to").alias("time"), F.lit(2).alias("side"), F.lit(-1).cast("long").alias("d"))
    change = begin.unionByName(end).groupBy("address", "time", "side").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"d_{k}") for k in kinds])
    seen = sightings.where(F.col("time").isNotNull()).join(change.select("address").distinct(), "address", "left_semi")
    rows = seen.withColumns({"side": F.lit(1), **{f"d_{k}": F.lit(0).cast("long") for k in kinds}}).unionByName(change, allowMissingColumns=True)
    run = ordered_scan(rows, ["address"], ["time", "side"], running={k: f"d_{k}" for k in kinds}, hot_rows=hot_rows)
    return run.where(F.col("side") == 1).drop("side", *[f"d_{k}" for k in kinds])


def tag_flags(tx: DataFrame, tags: DataFrame, scope: str = "wallet", at: Column | None = None, hot_rows: int | None = None) -> DataFrame:
    """JOI12: risky-tag flags per wallet.

    ``wallet`` scope looks at the tags of the wallet and its counterparties that are
    valid at the transfer's time (both ends included, a missing bound is open; a transfer without time meets no tag);
    ``global`` scope applies any tag to every wallet.
    """
    t = F.lower("tag")
    risky = tags.select("wallet_address", t.alias("tag"), "valid_from", "valid_to").where(t.isin([*RISKY_TAGS, "exchange"]))
    ends = F.array(F.struct(F.col("sender_wallet").alias("address"), F.col("receiver_wallet").alias("party")), F.struct(F.col("receiver_wallet").alias("address"), F.col("sender_wallet").alias("party")))
    if scope == "global":
        have = risky.select("tag").distinct()
        every = tx.select(F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet")).distinct()
        flags = {f"tag_{x}": have.where(F.col("tag") == x).exists() for x in NAMED_TAGS}
        any_risky = have.where(F.col("tag") != "exchange").exists()
        return every.select("wallet", any_risky.alias("tag_risky"), *[v.alias(k) for k, v in flags.items()])
    sides = tx.select((F.col("timestamp") if at is None else at).alias("time"), F.explode(ends).alias("e")).select("time", "e.address", "e.party")
    met = _tags_at(sides, risky, hot_rows).where(reduce(Column.__or__, [F.col(k) > 0 for k in (*NAMED_TAGS, "other", "exchange")]))
    both = met.select(F.explode(F.array("address", "party")).alias("wallet"), *NAMED_TAGS, "other", "exchange")
    risk = reduce(Column.__or__, [F.col(k) > 0 for k in (*NAMED_TAGS, "other")])
    return both.groupBy("wallet").agg(
        F.max(risk).alias("tag_risky"), *[F.max(F.col(x) > 0).alias(f"tag_{x}") for x in NAMED_TAGS], F.max(F.col("exchange") > 0).alias("near_exchange")
    )


def screening(edges: DataFrame, screened: DataFrame) -> DataFrame:
    """SET3: neighbours, how many of them are screened, and the share avoided."""
    nb = neighbours(edges)
    s = screened.select(F.col("wallet").alias("nb"), F.lit(1).alias("hit")).distinct()
    return nb.join(s, "nb", "left").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("neighbour_n"), F.count("hit").alias("screened_overlap"),
        (1 - F.count("hit") / F.count(F.lit(1))).alias("avoidance_ratio"), F.lit(True).alias("screening_known"),
    )


def distance_to(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Steps to the nearest target wallet, by breadth-first search from all targets at once.

    The search ends when it reaches no further wallet; unreachable wallets have no row.
    """
    nb = neighbours(edges)
    seen = cut_lineage(targets.select("wallet").distinct().withColumn("steps", F.lit(0)))
    for h in count(1):
        rim = seen.where(F.col("steps") == h - 1).join(nb, "wallet").select(F.col("nb").alias("wallet")).distinct()
        new = cut_lineage(rim.join(seen, "wallet", "left_anti").withColumn("steps", F.lit(h)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.select("wallet", F.col("steps").cast("double").alias("avg_path_length_to_exchange"))


def enrich(
    tx: DataFrame, edges: DataFrame, partition: DataFrame | None = None, tags: DataFrame | None = None,
    supplied: DataFrame | None = None, settings: Settings = DEFAULTS, scope: str = "wallet",
) -> DataFrame:
    """Every derivable input, plus caller-supplied wallet columns, as one table keyed by wallet."""
    hot = settings.hot_rows
    parts = [recent_sends(tx, settings.sequence_length), inflows(tx), send_intervals(tx, hot),
             new_recipients(tx, settings.window_hours), dormancy(tx, hot)]
    if partition is not None:
        parts += [cluster_edges(edges, partition), synchrony(tx, edges, partition, settings.sync_seconds, hot)]
    if tags is not None:
        parts.append(tag_flags(tx, tags, scope))
        watched = tags.where(F.lower("tag").isin(RISKY_TAGS)).select(F.col("wallet_address").alias("wallet"))
        parts.append(screening(edges, watched).drop("avoidance_ratio"))
        exchanges = tags.where(F.lower("tag") == "exchange").select(F.col("wallet_address").alias("wallet"))
        parts.append(distance_to(edges, exchanges))
    if supplied is not None:
        parts.append(supplied)
    return reduce(lambda a, b: a.join(b, "wallet", "full_outer"), parts)
