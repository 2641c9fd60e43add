"""Queries over readers, writers, cleaning and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Settings
from ..operators import cleaning as c
from ..operators.ordered import exact_quantile
from ..session import prepare
from ..sources import store
from ..sources import transfers as src
from ..sources.adapter import large_transfers, table, transfers
from .catalog import query
from .sql import D, I, S, T, select, sql


def scratch(spark, name: str) -> str:
    """A new folder for a query that writes and reads back: beside the checkpoints, so all executors reach it."""
    return f"{prepare(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def raw(spark, d):
    """Transfers as untyped text, some fields damaged, as an upload would deliver them."""
    t = transfers(spark, d)
    o = F.col("ord")
    return t.select(
        "transaction_id",
        F.when(o % 97 == 0, None).otherwise(F.col("sender_wallet")).alias("sender_wallet"),
        F.when(o % 89 == 0, None).otherwise(F.col("receiver_wallet")).alias("receiver_wallet"),
        F.when(o % 83 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(o % 79 == 0, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(o % 73 == 0, "free").otherwise(F.col("fee").cast("string")).alias("fee"),
        "ord",
    )


RAW = """(SELECT transaction_id, CASE WHEN ord % 97 = 0 THEN NULL ELSE sender_wallet END AS sender_wallet,
  CASE WHEN ord % 89 = 0 THEN NULL ELSE receiver_wallet END AS receiver_wallet,
  CASE WHEN ord % 83 = 0 THEN 0.0 ELSE amount END AS amount,
  CASE WHEN ord % 79 = 0 THEN NULL ELSE date_trunc('second', timestamp) END AS timestamp,
  CASE WHEN ord % 73 = 0 THEN NULL ELSE fee END AS fee, ord FROM tx_a)"""
KEPT = "sender_wallet IS NOT NULL AND receiver_wallet IS NOT NULL AND timestamp IS NOT NULL"


@query("cln1", select(S(transaction_id="transaction_id"), D(amount="amount", fee="fee"), T(timestamp="timestamp"), tail=f"FROM {RAW}"))
def cln1(spark, d):
    return c.coerce_types(raw(spark, d)).select("transaction_id", "amount", "fee", "timestamp")


@query("cln2", select(S(transaction_id="transaction_id", sender_wallet="sender_wallet", receiver_wallet="receiver_wallet"), tail=f"FROM {RAW} WHERE {KEPT}"))
def cln2(spark, d):
    return c.drop_incomplete(c.coerce_types(raw(spark, d))).select("transaction_id", "sender_wallet", "receiver_wallet")


@query("cln3", select(S(transaction_id="transaction_id", tx_hash="CAST(NULL AS VARCHAR)", label="CAST(NULL AS VARCHAR)"), D(fee="fee"), tail=f"FROM {RAW} WHERE {KEPT}"))
def cln3(spark, d):
    out = c.add_optional_columns(c.drop_incomplete(c.coerce_types(raw(spark, d))))
    return out.select("transaction_id", "tx_hash", "label", "fee")


@query("cln4", select(S(transaction_id="transaction_id"), D(amount="""CASE WHEN (SELECT count(*) FROM tx_a) > 100
  THEN least(amount, (SELECT quantile_cont(amount, 0.999) FROM tx_a)) ELSE amount END"""), tail="FROM tx_a"))
def cln4(spark, d):
    return c.clip_outliers(transfers(spark, d)).select("transaction_id", "amount")


@query("cln4_rank", sql("SELECT round(quantile_cont(amount, 0.999), 6) + 0.0 AS cap FROM tx_a"))
def cln4_rank(spark, d):
    """The rank-based quantile that replaces the single aggregation buffer on large tables."""
    cap = exact_quantile(transfers(spark, d), "amount", 0.999, hot_rows=500)
    return transfers(spark, d).agg(F.max(F.lit(cap)).alias("cap"))


@query("cln5", """SELECT CAST(l_orderkey AS BIGINT) l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber, round(min(l_extendedprice), 6) + 0.0 AS lowest
FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) GROUP BY 1, 2""")
def cln5(spark, d):
    """Repeated (l_orderkey, l_linenumber) keys keep their first row."""
    li = table(spark, d, "lineitem")
    first = c.keep_first(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return first.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("lowest"))


@query("cln6", select(S(transaction_id="transaction_id"), I(position="row_number() OVER (ORDER BY timestamp, ord)"), tail="FROM tx_a"))
def cln6(spark, d):
    return c.add_position(transfers(spark, d)).select("transaction_id", "position")


@query("cln7", select(S(transaction_id="transaction_id", sender_wallet="sender_wallet",
                        receiver_wallet="CASE WHEN ord % 3 = 0 THEN sender_wallet ELSE receiver_wallet END", asset_type="asset_type"), D(amount="amount"), tail="FROM tx_a"))
def cln7(spark, d):
    """A table that uses other column names, with an empty first alias in some rows."""
    t = transfers(spark, d)
    odd = t.select(
        F.col("transaction_id").alias("tx_id"), F.col("sender_wallet").alias("from"),
        F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("receiver_wallet")).alias("receiver"),
        F.col("sender_wallet").alias("to_address"), F.col("amount").alias("value"), F.col("asset_type").alias("token"), "timestamp",
    )
    return c.resolve_aliases(odd).select("transaction_id", "sender_wallet", "receiver_wallet", "asset_type", "amount")


@query("cln8", select(S(transaction_id="transaction_id", sender_wallet="sender_wallet", receiver_wallet="receiver_wallet",
                        timestamp="strftime(timestamp, '%Y-%m-%d %H:%M:%S')", tx_hash="CAST(NULL AS VARCHAR)", asset_type="asset_type",
                        chain_id="chain_id", label="label", label_source="CAST(NULL AS VARCHAR)"), D(amount="amount", fee="fee"), tail="FROM tx_a"))
def cln8(spark, d):
    return c.storage_rows(transfers(spark, d))


@query("src1", select(S(transaction_id="transaction_id", sender_wallet="sender_wallet", receiver_wallet="receiver_wallet"), D(amount="amount", fee="fee"), T(timestamp="date_trunc('millisecond', timestamp)"), tail="FROM tx_a"))
def src1(spark, d):
    """CSV written and read back with header checks, then typed."""
    path = scratch(spark, "csv")
    store.export_csv(transfers(spark, d).drop("ord"), path)
    return c.coerce_types(src.read_transfer_csv(spark, path)).select("transaction_id", "sender_wallet", "receiver_wallet", "amount", "fee", "timestamp")


SRC2 = select(I(file_no="file_no", n="count(*)"), D(amount="sum(amount)"), tail="""
FROM (SELECT amount, CASE WHEN asset_type = 'click' THEN 0 WHEN asset_type = 'view' THEN 1 ELSE 2 END AS file_no FROM tx_a) GROUP BY file_no""")


@query("src2", SRC2)
def src2(spark, d):
    """Three inputs of different width united by name."""
    t = transfers(spark, d)
    kinds = [F.col("asset_type") == "click", F.col("asset_type") == "view", ~F.col("asset_type").isin("click", "view")]
    parts = [t.where(k).drop(*(["fee"] if i == 1 else [])).withColumns({"file_no": F.lit(i), "row_no": F.col("ord")}) for i, k in enumerate(kinds)]
    return src.union_in_order(parts).groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def labelled_frames(spark, d):
    """Feature, class and edge files in the three-file layout, derived from embeddings and transfers."""
    e = table(spark, d, "embeddings")
    feats = e.select(F.col("vec_id").cast("string"), (F.col("vec_id") % 49 + 1).cast("string"), *[F.col("embedding")[i].cast("string") for i in range(64)])
    cls = e.select(F.col("vec_id").alias("txId"), F.when(F.col("label") == 0, "1").when(F.col("label") == 1, "2").otherwise("unknown").alias("class"))
    n = e.count()
    edges = transfers(spark, d).select(
        (F.substring("sender_wallet", 2, 20).cast("bigint") % n).alias("txId1"), (F.substring("receiver_wallet", 2, 20).cast("bigint") % n).alias("txId2")
    )
    return feats, cls, edges


@query("src3", """WITH e AS (SELECT vec_id, embedding, CASE WHEN label = 0 THEN 'illicit' WHEN label = 1 THEN 'licit' END AS label FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS node_id, CAST(vec_id % 49 + 1 AS BIGINT) AS time_step, label,
  epoch_us(TIMESTAMP '2019-01-01' + to_hours(CAST(vec_id % 49 + 1 AS BIGINT))) AS timestamp,
  round(list_sum(list_transform(embedding, lambda x: abs(CAST(CAST(x AS VARCHAR) AS DOUBLE)))), 4) + 0.0 AS amount FROM e""")
def src3(spark, d):
    """Three-file labelled graph written as CSV and read back."""
    base = scratch(spark, "labelled")
    feats, cls, edges = labelled_frames(spark, d)
    feats.write.csv(f"{base}/f", header=False)
    cls.write.csv(f"{base}/c", header=True)
    edges.write.csv(f"{base}/e", header=True)
    got = src.read_labelled_graph(spark, f"{base}/f", f"{base}/c", f"{base}/e")["nodes"]
    return got.withColumn("amount", F.round("amount", 4))


@query("src4", select(S(transaction_id="transaction_id"), D(amount="amount"), tail="FROM tx_h"))
def src4(spark, d):
    """Two runs in one partitioned table; one is read back by its run id."""
    path = scratch(spark, "runs")
    store.append_run(transfers(spark, d).select("transaction_id", "amount"), path, "all")
    store.append_run(large_transfers(spark, d).select("transaction_id", "amount"), path, "large")
    return store.read_run(spark, path, "large").select("transaction_id", "amount")


@query("src6")
def src6(spark, d):
    """Training tables read from a folder; the optional ones fall back to the main table."""
    path = scratch(spark, "train")
    t = transfers(spark, d)
    t.select("transaction_id", "amount", F.coalesce((F.col("label") == "illicit").cast("int"), F.lit(0)).alias("label")).write.parquet(f"{path}/train_features.parquet")
    t.select(F.col("sender_wallet").alias("src"), F.col("receiver_wallet").alias("dst")).write.csv(f"{path}/edges.csv", header=True)
    got = store.read_training_tables(spark, path)
    counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in sorted(got.items())]
    return src.union_in_order(counts)


@query("snk1", select(S(run_id="run_id"), I(n="count(*)"), tail="FROM (SELECT 'first' AS run_id FROM tx_h UNION ALL SELECT 'second' FROM tx_a) GROUP BY 1"))
def snk1(spark, d):
    path = scratch(spark, "append")
    store.append_run(large_transfers(spark, d), path, "first")
    store.append_run(transfers(spark, d), path, "second")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("snk2", select(S(wallet="wallet"), D(score="score"), tail="""FROM (
  SELECT sender_wallet AS wallet, arg_max(amount, ord) AS score FROM tx_h GROUP BY 1
  UNION ALL SELECT sender_wallet, max(fee) FROM tx_a WHERE sender_wallet NOT IN (SELECT sender_wallet FROM tx_h) GROUP BY 1)"""))
def snk2(spark, d):
    """A stored score per wallet replaced by the last new one where there is one."""
    old = transfers(spark, d).groupBy(F.col("sender_wallet").alias("wallet")).agg(F.max("fee").alias("score"))
    new = large_transfers(spark, d).select(F.col("sender_wallet").alias("wallet"), F.col("amount").alias("score"), "ord")
    return store.upsert(old, new, ["wallet"], ["ord"]).select("wallet", "score")


@query("snk2_table", select(S(wallet="wallet"), D(score="score"), tail="""FROM (
  SELECT sender_wallet AS wallet, arg_max(amount, ord) AS score FROM tx_h GROUP BY 1
  UNION ALL SELECT sender_wallet, max(fee) FROM tx_a WHERE sender_wallet NOT IN (SELECT sender_wallet FROM tx_h) GROUP BY 1)"""))
def snk2_table(spark, d):
    """The same on a stored table of buckets, of which only those with a new score are written again."""
    path = scratch(spark, "scores")
    store.upsert_table(path, transfers(spark, d).groupBy(F.col("sender_wallet").alias("wallet")).agg(F.max("fee").alias("score")), ["wallet"], buckets=16)
    new = large_transfers(spark, d).select(F.col("sender_wallet").alias("wallet"), F.col("amount").alias("score"), "ord")
    store.upsert_table(path, new, ["wallet"], ["ord"], buckets=16)
    return store.read_upserted(spark, path).select("wallet", "score")


@query("snk3", select(S(src="src", dst="dst"), D(amount="amount"), tail="FROM ed_a"))
def snk3(spark, d):
    """Edge table exported to CSV and read back."""
    from ..operators.graph import wallet_edges

    path = scratch(spark, "export")
    store.export_csv(wallet_edges(transfers(spark, d)).select("src", "dst", "amount"), path)
    return spark.read.csv(path, header=True, schema="src string, dst string, amount double")


@query("snk4", sql("""SELECT CAST(i // 2500 AS BIGINT) AS slice, count(*) AS n
FROM (SELECT row_number() OVER () - 1 AS i FROM tx_a) GROUP BY 1"""))
def snk4(spark, d):
    """Seeded shuffle cut into files of 2,500 rows."""
    cut = store.shuffled_slices(transfers(spark, d), "transaction_id", 42, 2500)
    path = scratch(spark, "slices")
    store.write_slices(cut, path)
    return spark.read.csv(path, header=True).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("fil1", select(S(transaction_id="transaction_id"), tail="FROM tx_a WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20'"))
def fil1(spark, d):
    return c.between_times(transfers(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("transaction_id")


@query("fil2", select(S(transaction_id="transaction_id"), T(timestamp="timestamp"), tail="FROM tx_w"))
def fil2(spark, d):
    return c.trailing_hours(transfers(spark, d), 24).select("transaction_id", "timestamp")


@query("cln_all", select(I(rows_kept="count(*)"), D(total="sum(least(amount, cap))"), tail=f"""
FROM (SELECT *, quantile_cont(amount, 0.999) OVER () AS cap FROM {RAW} WHERE {KEPT})"""))
def cln_all(spark, d):
    """The whole cleaning step."""
    done = c.clean(raw(spark, d), Settings())
    return done.agg(F.count(F.lit(1)).alias("rows_kept"), F.sum("amount").alias("total"))
