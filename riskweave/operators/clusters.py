"""Wallet clusters: membership, facts, flow roles and community statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_members(components: DataFrame, marked: DataFrame, min_size: int = 2) -> DataFrame:
    """CLU1 / SET2: marked wallets per component, kept when there are ``min_size``; the id is the component's name."""
    hit = components.join(marked.select("wallet").distinct(), "wallet", "left_semi")
    big = hit.groupBy("component").agg(F.count(F.lit(1)).alias("n_marked")).where(F.col("n_marked") >= min_size)
    return hit.join(big.select("component"), "component", "left_semi").select(F.col("component").alias("cluster_id"), "wallet")


def cluster_density(components: DataFrame, members: DataFrame) -> DataFrame:
    """Members per wallet of the component."""
    size = components.groupBy(F.col("component").alias("cluster_id")).agg(F.count(F.lit(1)).alias("component_size"))
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("wallet_count"))
    return n.join(size, "cluster_id").withColumn("density_risk", F.col("wallet_count") / F.col("component_size"))


def cluster_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges inside a cluster."""
    s = members.select(F.col("wallet").alias("src"), "cluster_id")
    d = members.select(F.col("wallet").alias("dst"), F.col("cluster_id").alias("cd"))
    return edges.join(s, "src").join(d, "dst").where(F.col("cluster_id") == F.col("cd")).drop("cd")


def cluster_transfers(tx: DataFrame, members: DataFrame) -> DataFrame:
    """Transfers touching a member. Both ends lie in one component, so one cluster at most."""
    s = members.select(F.col("wallet").alias("sender_wallet"), F.col("cluster_id").alias("cs"))
    r = members.select(F.col("wallet").alias("receiver_wallet"), F.col("cluster_id").alias("cr"))
    j = tx.join(s, "sender_wallet", "left").join(r, "receiver_wallet", "left")
    return j.withColumn("cluster_id", F.coalesce("cs", "cr")).drop("cs", "cr").where(F.col("cluster_id").isNotNull())


def cluster_facts(edges: DataFrame, scored: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """CLU2: amount and distinct edges inside the cluster; risk is the mean score of its transfers, else density."""
    inner = cluster_edges(edges, members).groupBy("cluster_id").agg(
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("tx_count")
    )
    risk = cluster_transfers(scored, members).groupBy("cluster_id").agg(F.avg("meta_score").alias("mean_meta"))
    base = cluster_density(components, members)
    out = base.join(inner, "cluster_id", "left").join(risk, "cluster_id", "left")
    return out.select(
        "cluster_id", "wallet_count", "component_size", "density_risk",
        F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"),
        F.coalesce("tx_count", F.lit(0)).cast("bigint").alias("tx_count"),
        F.coalesce("mean_meta", "density_risk").alias("risk_score"),
        F.format_string("Cluster (%d wallets)", F.col("wallet_count")).alias("label"),
    )


def assign_clusters(tx: DataFrame, members: DataFrame) -> DataFrame:
    """CLU3: the sender's cluster, else the receiver's, else null."""
    s = members.select(F.col("wallet").alias("sender_wallet"), F.col("cluster_id").alias("cs"))
    r = members.select(F.col("wallet").alias("receiver_wallet"), F.col("cluster_id").alias("cr"))
    j = tx.join(s, "sender_wallet", "left").join(r, "receiver_wallet", "left")
    return j.withColumn("cluster_id", F.coalesce("cs", "cr")).drop("cs", "cr")


def case_facts(edges: DataFrame, components: DataFrame, marked: DataFrame, min_size: int = 3) -> DataFrame:
    """CLU4: cases are components with ``min_size`` high-risk wallets; facts cover the whole component."""
    members = cluster_members(components, marked, min_size)
    dens = cluster_density(components, members)
    comp = components.select("wallet", F.col("component").alias("cluster_id"))
    inner = cluster_edges(edges, comp).groupBy("cluster_id").agg(
        F.sum("amount").alias("total_amount"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")
    )
    out = dens.join(inner, "cluster_id", "left")
    return out.select(
        F.col("cluster_id").alias("case_id"),
        F.format_string("Suspicious Network (%d wallets)", F.col("wallet_count")).alias("case_name"),
        F.col("density_risk").alias("risk_score"), "total_amount", "start_time", "end_time", "wallet_count", "component_size",
        F.format_string(
            "Cluster of %d wallets with %d high-risk nodes. Total flow: %.2f",
            F.col("component_size"), F.col("wallet_count"), F.col("total_amount"),
        ).alias("explanation"),
    )


def member_degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """In- and out-degree inside the cluster for every member."""
    inner = cluster_edges(edges, members)
    ends = inner.select(
        F.explode(
            F.array(
                F.struct("cluster_id", F.col("src").alias("wallet"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct("cluster_id", F.col("dst").alias("wallet"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    zero = members.select("cluster_id", "wallet", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.unionByName(zero).groupBy("cluster_id", "wallet").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))


def flow_roles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """GRA19: source, exit or layer per member; clusters of two or more get at least one source and one exit.

    Only minima per cluster are needed, so no cluster is sorted in one task.
    """
    d = member_degrees(edges, members)
    entry = d.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("in_deg") == 0, F.col("wallet"))).alias("natural_entry"),
        F.count_if((F.col("out_deg") == 0) & (F.col("in_deg") != 0)).alias("n_exit"),
        F.min(F.struct("in_deg", "wallet")).alias("low_in"),
    )
    entry = entry.withColumn("entry", F.coalesce("natural_entry", F.col("low_in.wallet")))
    j = d.join(entry, "cluster_id")
    forced = F.col("natural_entry").isNull() & (F.col("wallet") == F.col("entry"))
    picks = j.where(F.col("wallet") != F.col("entry")).groupBy("cluster_id").agg(F.min(F.struct("out_deg", "wallet")).alias("low_out"))
    j = j.join(picks, "cluster_id", "left")
    has_exit = F.col("n_exit") > 0
    role = (
        F.when(F.col("n") == 1, "source")
        .when(~has_exit & (F.col("wallet") == F.col("low_out.wallet")), "exit")
        .when((F.col("in_deg") == 0) | forced, "source")
        .when(F.col("out_deg") == 0, "exit")
        .otherwise("layer")
    )
    return j.select("cluster_id", "wallet", "in_deg", "out_deg", role.alias("role"))


def partition_risk(edges: DataFrame, partition: DataFrame, node_risk: DataFrame) -> DataFrame:
    """GRA17: size, density, internal edges, mean and maximum node risk per community."""
    m = partition.select("wallet", F.col("community").alias("cluster_id"))
    inner = cluster_edges(edges, m).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("internal_edges"))
    risk = m.join(node_risk, "wallet", "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg(F.coalesce("risk", F.lit(0.0))).alias("mean_risk"),
        F.max(F.coalesce("risk", F.lit(0.0))).alias("max_risk"),
    )
    return with_density(risk.join(inner, "cluster_id", "left").na.fill({"internal_edges": 0}))


def with_density(df: DataFrame) -> DataFrame:
    n = F.col("size")
    return df.withColumn("density", F.when(n > 1, F.col("internal_edges") / (n * (n - 1))).otherwise(0.0))


def embedding_spread(members: DataFrame, embeddings: DataFrame, most_wallets: int = 100_000) -> DataFrame:
    """Length of the mean vector and mean deviation over the dimensions, per cluster of ``members(cluster_id, wallet)``.

    Whole vectors are dealt by cluster, a row per wallet, and summed where they lie. Clusters of more than ``most_wallets`` are summed per
    (cluster, dimension) before they are dealt, so that none has to lie in one task.
    """
    large = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_wallets).select("cluster_id")
    has_large = not large.isEmpty()
    large = F.broadcast(large)
    vectors = members.join(embeddings, "wallet").select("cluster_id", "embedding")
    dims = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    found = []
    if dims > 0:
        few = vectors.join(large, "cluster_id", "left_anti") if has_large else vectors
        at = [F.get("embedding", F.lit(i)) for i in range(dims)]
        per = few.repartition("cluster_id").groupBy("cluster_id").agg(
            F.filter(F.array(*[F.avg(x) for x in at]), F.isnotnull).alias("mu"), F.filter(F.array(*[F.stddev_pop(x) for x in at]), F.isnotnull).alias("sd")
        )
        total = F.aggregate("sd", F.lit(0.0), lambda t, x: t + x)
        norm = F.sqrt(F.aggregate("mu", F.lit(0.0), lambda t, x: t + x * x))
        found.append(per.select("cluster_id", norm.alias("emb_mean_norm"), F.when(F.size("sd") > 0, total / F.size("sd")).alias("emb_std_mean")))
    if has_large or not found:
        many = vectors.join(large, "cluster_id", "left_semi")
        per = many.select("cluster_id", F.posexplode("embedding").alias("dim", "x")).groupBy("cluster_id", "dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
        found.append(per.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("mu") * F.col("mu"))).alias("emb_mean_norm"), F.avg("sd").alias("emb_std_mean")))
    return reduce(DataFrame.unionByName, found)


def community_features(
    edges: DataFrame, metrics: DataFrame, partition: DataFrame, embeddings: DataFrame | None = None, most_wallets: int = 100_000
) -> DataFrame:
    """GRA18: size, density, internal and external edges, mean degrees, embedding mean norm and mean spread."""
    m = partition.select("wallet", F.col("community").alias("cluster_id"))
    inner = cluster_edges(edges, m).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("internal_edges"))
    deg = m.join(metrics, "wallet", "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.coalesce("in_degree", F.lit(0))).alias("_in"), F.sum(F.coalesce("out_degree", F.lit(0))).alias("_out"),
    )
    out = with_density(deg.join(inner, "cluster_id", "left").na.fill({"internal_edges": 0}))
    out = out.withColumns(
        {
            "external_edges": F.col("_in") + F.col("_out") - 2 * F.col("internal_edges"),
            "avg_in_degree": F.col("_in") / F.col("size"), "avg_out_degree": F.col("_out") / F.col("size"),
        }
    ).drop("_in", "_out")
    if embeddings is None:
        return out.withColumns({"emb_mean_norm": F.lit(0.0), "emb_std_mean": F.lit(0.0)})
    emb = embedding_spread(m, embeddings, most_wallets)
    return out.join(emb, "cluster_id", "left").na.fill({"emb_mean_norm": 0.0, "emb_std_mean": 0.0})


def community_labels(partition: DataFrame, labels: DataFrame | None, features: DataFrame | None = None) -> DataFrame:
    """AGG17: label 1 when at least half of a community's labelled wallets are illicit; without labels, dense communities."""
    if labels is not None:
        j = partition.join(labels, "wallet")
        frac = j.groupBy(F.col("community").alias("cluster_id")).agg(F.avg(F.col("label").cast("double")).alias("illicit_fraction"))
        return frac.withColumn("label", (F.col("illicit_fraction") >= 0.5).cast("int"))
    from .ordered import exact_quantile

    cut = exact_quantile(features, "density", 0.9)
    return features.select("cluster_id", (F.col("density") > F.lit(cut)).cast("int").alias("label"))


def entity_scores(features: DataFrame, partition: DataFrame) -> DataFrame:
    """LEN4 without a model: ``min(density * size / 100, 1)`` for every member."""
    s = features.select(
        F.col("cluster_id").alias("community"), F.least(F.col("density") * F.col("size") / 100.0, F.lit(1.0)).alias("entity_score")
    )
    return partition.join(s, "community").select("wallet", "community", "entity_score")


def elements(edges: DataFrame, members: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """GRA20 / GRA21: node and edge elements of each cluster's graph, one JSON text per row."""
    n = members if notes is None else members.join(notes, "wallet", "left")
    extra = [] if notes is None else [c for c in notes.columns if c != "wallet"]
    node = n.select(
        "cluster_id", F.lit("node").alias("kind"), F.col("wallet").alias("key"),
        F.to_json(F.struct(F.struct(F.col("wallet").alias("id"), *extra).alias("data"))).alias("element"),
    )
    edge = cluster_edges(edges, members).select(
        "cluster_id", F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("key"),
        F.to_json(
            F.struct(F.struct(
                F.col("src").alias("source"), F.col("dst").alias("target"), "amount",
                F.col("timestamp").cast("string").alias("timestamp"),
            ).alias("data"))
        ).alias("element"),
    )
    return node.unionByName(edge)


def wallet_notes(scored: DataFrame, flagged: DataFrame) -> DataFrame:
    """GRA21: best score of a wallet's transfers with that transfer's level, and whether a suspicious one touches it.

    Equal scores take the earliest transfer.
    """
    ends = scored.select("meta_score", "risk_level", "ord", F.explode(F.array("sender_wallet", "receiver_wallet")).alias("wallet"))
    best = ends.where((F.col("wallet") != "") & F.col("meta_score").isNotNull()).groupBy("wallet").agg(
        F.max_by(F.struct("meta_score", "risk_level"), F.struct("meta_score", -F.col("ord"))).alias("b")
    )
    from .selection import touched_wallets

    sus = touched_wallets(flagged).withColumn("suspicious", F.lit(True))
    return best.join(sus, "wallet", "full_outer").select(
        "wallet", F.coalesce("suspicious", F.lit(False)).alias("suspicious"),
        F.col("b.meta_score").alias("meta_score"), F.col("b.risk_level").alias("risk_level"),
    )
