"""Per-wallet features over the trailing window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scalars import entropy_term, normalised_entropy, seconds_after
from ..session import cut_lineage
from .cleaning import trailing_hours
from .cycles import cycles_per_wallet, simple_cycles
from .graph import real_pair, roles, wallet_edges
from .ordered import ordered_scan

ORDER = ["timestamp", "ord"]


def active_wallets(win: DataFrame) -> DataFrame:
    """SET1: senders and receivers of the window, self-transfers included."""
    return win.select(F.col("sender_wallet").alias("wallet")).union(win.select("receiver_wallet")).where(F.col("wallet").isNotNull()).distinct()


def peel_chain(win: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """WIN7: longest strictly decreasing run of a sender's amounts, minus one."""
    s = ordered_scan(win, ["sender_wallet"], ORDER, lag={"_pa": "amount"}, hot_rows=hot_rows)
    s = s.withColumn("_break", F.when(F.col("amount") < F.col("_pa"), 0).otherwise(1))
    s = ordered_scan(s, ["sender_wallet"], ORDER, running={"_run": "_break"}, hot_rows=hot_rows)
    runs = s.groupBy("sender_wallet", "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(F.col("sender_wallet").alias("wallet")).agg((F.max("n") - 1).alias("peel_chain_score"))


def synchronised_sends(win: DataFrame, seconds: int = 60, hot_rows: int | None = None) -> DataFrame:
    """WIN8 / JOI7: sends with another transfer to the same receiver within ``seconds``.

    Two transfers lie within range exactly when one of them is the other's nearest
    neighbour in time or closer, so lag and lead replace the range self-join.
    """
    s = ordered_scan(win, ["receiver_wallet"], ORDER, lag={"_p": "timestamp"}, lead={"_n": "timestamp"}, hot_rows=hot_rows)
    near = (seconds_after("timestamp", "_p") <= seconds) | (seconds_after("_n", "timestamp") <= seconds)
    return s.withColumn("synchronised", F.coalesce(near, F.lit(False))).drop("_p", "_n")


def synchronised_score(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(F.col("sender_wallet").alias("wallet")).agg(
        F.count_if("synchronised").alias("synchronized_transfer_score")
    )


def reconvergence(edges: DataFrame, hub_degree: int = 10_000) -> DataFrame:
    """GRA6: share of a wallet's successor pairs that have a common successor.

    Successors with the same set of shared targets are interchangeable, so pairs
    are formed between such classes and weighted by class sizes; a class of any
    size costs one row. A successor that is a hub on both sides would multiply its
    predecessors by its targets; its pairs are counted from the wallets that share
    a target with it instead. The result is the same at any ``hub_degree``.
    """
    e = edges.select("src", "dst")
    k = e.groupBy(F.col("src").alias("wallet")).agg(F.count(F.lit(1)).alias("k"))
    hubs = (
        k.where(F.col("k") > hub_degree).select(F.col("wallet").alias("a"))
        .join(e.groupBy(F.col("dst").alias("a")).agg(F.count(F.lit(1)).alias("i")).where(F.col("i") > hub_degree), "a")
        .select("a")
    )
    has_hubs = not hubs.isEmpty()
    up = e.select(F.col("src").alias("w"), F.col("dst").alias("a"))
    light = up.join(hubs, "a", "left_anti") if has_hubs else up
    reach = light.join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a")
    shared = reach.groupBy("w", "c").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2).select("w", "c")
    hit = reach.join(shared, ["w", "c"])
    mark = hit.groupBy("w", "a").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(7), "c")).alias("h2"),
    )
    mark = cut_lineage(mark.select("w", "a", F.struct("n", "h1", "h2").alias("cls")))
    size = mark.groupBy("w", "cls").agg(F.count(F.lit(1)).alias("sz"), F.min("a").alias("a"))
    within = size.groupBy("w").agg(F.sum(F.col("sz") * (F.col("sz") - 1) / 2).alias("p"))
    one = size.join(hit, ["w", "a"]).select("w", "c", F.col("a").alias("r1"), F.col("sz").alias("z1"))
    two = one.select("w", "c", F.col("r1").alias("r2"), F.col("z1").alias("z2"))
    cross = one.join(two, ["w", "c"]).where(F.col("r1") < F.col("r2")).select("w", "r1", "r2", "z1", "z2").distinct()
    across = cross.groupBy("w").agg(F.sum(F.col("z1") * F.col("z2")).alias("p"))
    counts = within.unionByName(across.select("w", F.col("p").cast("double").alias("p")))
    if has_hubs:
        counts = counts.unionByName(_hub_pairs(e, up, hubs))
    got = counts.groupBy(F.col("w").alias("wallet")).agg(F.sum("p").alias("got"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    ratio = F.when(F.col("k") > 1, F.coalesce("got", F.lit(0.0)) / pairs).otherwise(0.0)
    return k.join(got, "wallet", "left").select("wallet", ratio.alias("reconvergence_score"))


def _hub_pairs(e: DataFrame, up: DataFrame, hubs: DataFrame) -> DataFrame:
    """Successor pairs with at least one hub: wallets that share a target with the hub, then a join on both ends."""
    targets = e.join(hubs, e.src == hubs.a, "left_semi").select(F.col("src").alias("hub"), F.col("dst").alias("c"))
    mates = targets.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "c").where(F.col("b") != F.col("hub"))
    mates = mates.select("hub", "b").distinct()
    both = mates.join(hubs.select(F.col("a").alias("b"), F.lit(True).alias("b_hub")), "b", "left")
    mates = both.where(F.col("b_hub").isNull() | (F.col("b") > F.col("hub"))).select("hub", "b")
    beside = up.join(hubs, "a", "left_semi").select("w", F.col("a").alias("hub"))
    pairs = beside.join(up.select("w", F.col("a").alias("b")), "w").join(mates, ["hub", "b"])
    return pairs.groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("p"))


def longest_hops(win: DataFrame, slice_rows: int = 100_000, most_pairs: int = 1_000_000) -> DataFrame:
    """GRA7: longest time-respecting walk starting at each wallet.

    Time is cut into slices, the latest first. In parallel, each is reduced to the most transfers of a walk from one
    wallet to another inside it; a slice of more than ``most_pairs`` such pairs is cut further. The slices are then put
    together from the end: a walk that reaches a wallet goes on by that wallet's longest walk in the slices behind. One small join and one
    maximum per slice, however long the walks are.
    """
    at = ["timestamp", "ord"]
    step = win.select(F.col("sender_wallet").alias("s"), F.col("receiver_wallet").alias("r"), *at)
    parts = max(1, -(-step.count() // slice_rows))
    down = [F.col(c).desc() for c in at]
    cut = step.repartitionByRange(parts, *down).sortWithinPartitions(*down).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict = {}  # wallet -> {wallet reached: most transfers}, over the transfers read so far, which are later ones
        size = piece = 0
        part = None

        def told():
            rows = [(part, piece, a, b, n) for a, to in ways.items() for b, n in to.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "piece", "a", "b", "hops"])

        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for part, s, r in zip(*(batch.column(c).to_pylist() for c in ("part", "s", "r"))):
                mine = ways.setdefault(s, {})
                size -= len(mine)
                on = ways.get(r, {}) if r is not None else {}
                for b, n in list(on.items()):
                    if mine.get(b, 0) <= n:
                        mine[b] = n + 1
                mine.setdefault(r, 1)
                size += len(mine)
                if size > most_pairs:
                    yield told()
                    ways, size, piece = {}, 0, piece + 1
        if ways:
            yield told()

    maps = cut_lineage(cut.select("part", "s", "r").mapInArrow(run, "part int, piece int, a string, b string, hops long"))
    best = None
    for slice_ in maps.select("part", "piece").distinct().orderBy("part", "piece").collect():
        here = maps.where((F.col("part") == slice_.part) & (F.col("piece") == slice_.piece))
        new = here.select(F.col("a").alias("wallet"), "hops")
        if best is not None:
            on = here.join(best.select(F.col("wallet").alias("b"), F.col("hops").alias("more")), "b")
            new = new.unionByName(on.select(F.col("a").alias("wallet"), (F.col("hops") + F.col("more")).alias("hops"))).unionByName(best)
        best = cut_lineage(new.groupBy("wallet").agg(F.max("hops").alias("hops")))
    if best is None:
        best = maps.select(F.col("a").alias("wallet"), "hops")
    return best.select("wallet", F.col("hops").cast("int").alias("hop_count_in_window"))


def splitting(edges: DataFrame) -> DataFrame:
    """GRA8: entropy of a wallet's outgoing edge amounts, raw and relative to its maximum."""
    e = edges.where(F.col("amount") > 0)
    total = e.groupBy("src").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    terms = e.join(total, "src").groupBy("src", "n").agg(F.sum(entropy_term(F.col("amount") / F.col("total"))).alias("h"))
    return terms.select(
        F.col("src").alias("wallet"), F.col("h").alias("fund_splitting_entropy"),
        normalised_entropy(F.col("h"), F.col("n")).alias("fragmentation_score"),
    )


def velocity(win: DataFrame) -> DataFrame:
    """GRA9: sent plus received per second of activity."""
    span = seconds_after(F.max("timestamp"), F.min("timestamp"))
    return roles(win).groupBy("wallet").agg(((F.sum("sent") + F.sum("received")) / (span + 1.0)).alias("velocity_score"))


WINDOW_METRICS = [
    "hop_count_in_window", "fragmentation_score", "reconvergence_score", "peel_chain_score", "circularity_score",
    "velocity_score", "synchronized_transfer_score", "fund_splitting_entropy",
]


def window_features(tx: DataFrame, settings: Settings = DEFAULTS, max_cycle: int = 10) -> DataFrame:
    """GRA10: the eight window metrics of every wallet active in the window."""
    win = cut_lineage(trailing_hours(tx.where(F.col("timestamp").isNotNull()), settings.window_hours))
    edges = cut_lineage(wallet_edges(win.where(real_pair())))
    hot = settings.hot_rows
    parts = [
        longest_hops(win), splitting(edges), reconvergence(edges), peel_chain(win, hot),
        cycles_per_wallet(simple_cycles(edges, max_cycle)), velocity(win),
        synchronised_score(synchronised_sends(win, settings.sync_seconds, hot)),
    ]
    out = reduce(lambda a, b: a.join(b, "wallet", "left"), parts, active_wallets(win))
    return out.na.fill(0).select("wallet", *WINDOW_METRICS)
