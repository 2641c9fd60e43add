"""Queries over ordered per-wallet operators, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..operators import paging, tx_features as tf
from ..operators.cleaning import trailing_hours
from ..operators.fusion import precision_recall_points
from ..operators.graph import wallet_edges
from ..operators.lenses import sequence_rows
from ..operators.rules.engine import peel_edges
from ..operators.typology import most_common
from ..operators.window24 import peel_chain, synchronised_score, synchronised_sends, window_features
from ..sources.adapter import table, transfers
from .catalog import ORACLES, query
from .q_graph import cycle_walk, reconvergence_sql
from .sql import D, I, S, T, select, sql

GAPS = """(SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY sender_wallet ORDER BY timestamp, ord) AS gap FROM tx_a)"""


@query("win1", select(S(transaction_id="transaction_id"), I(sender_tx_count="count(*) OVER (PARTITION BY sender_wallet)", receiver_tx_count="count(*) OVER (PARTITION BY receiver_wallet)"), tail="FROM tx_a"))
def win1(spark, d):
    return tf.activity_counts(transfers(spark, d)).select("transaction_id", "sender_tx_count", "receiver_tx_count")


WIN2 = select(S(transaction_id="transaction_id"), D(time_since_prev_out="coalesce(gap, 0) / 1e6"), tail=f"FROM {GAPS}")


@query("win2", WIN2)
def win2(spark, d):
    return tf.send_history(transfers(spark, d)).select("transaction_id", "time_since_prev_out")


@query("win2_split", WIN2)
def win2_split(spark, d):
    """The same result with groups above 17 rows split over several tasks."""
    return tf.send_history(transfers(spark, d), hot_rows=17).select("transaction_id", "time_since_prev_out")


@query("win3", select(S(transaction_id="transaction_id"), D(time_since_prev_in="""coalesce(epoch_us(timestamp)
  - lag(epoch_us(timestamp)) OVER (PARTITION BY receiver_wallet ORDER BY timestamp, ord), 0) / 1e6"""), tail="FROM tx_a"))
def win3(spark, d):
    return tf.receive_gaps(transfers(spark, d)).select("transaction_id", "time_since_prev_in")


@query("win4", select(S(transaction_id="transaction_id"), I(sender_repeat_count="row_number() OVER (PARTITION BY sender_wallet, receiver_wallet ORDER BY timestamp, ord)"), tail="FROM tx_a"))
def win4(spark, d):
    return tf.repeat_index(transfers(spark, d)).select("transaction_id", "sender_repeat_count")


@query("win5", select(S(sender_wallet="sender_wallet"), D(burstiness_score="round(CASE WHEN count(*) >= 3 THEN stddev_pop(gap / 1e6) ELSE 0 END, 3)"), tail=f"FROM {GAPS} GROUP BY 1"))
def win5(spark, d):
    return tf.burstiness(tf.send_history(transfers(spark, d))).withColumn("burstiness_score", F.round("burstiness_score", 3))


WIN6 = select(S(transaction_id="transaction_id"), D(amount_deviation="CASE WHEN sd > 0 THEN (amount - mu) / sd ELSE 0 END"), tail="""
FROM (SELECT *, avg(amount) OVER w AS mu, stddev_pop(amount) OVER w AS sd FROM tx_a
WINDOW w AS (PARTITION BY sender_wallet ORDER BY timestamp, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")


@query("win6", WIN6)
def win6(spark, d):
    return tf.send_history(transfers(spark, d)).select("transaction_id", "amount_deviation")


@query("win6_split", WIN6)
def win6_split(spark, d):
    return tf.send_history(transfers(spark, d), hot_rows=17).select("transaction_id", "amount_deviation")


WIN7 = select(S(wallet="sender_wallet"), I(peel_chain_score="max(n) - 1"), tail="""
FROM (SELECT sender_wallet, run, count(*) n FROM (SELECT *, sum(brk) OVER (PARTITION BY sender_wallet ORDER BY timestamp, ord) AS run
FROM (SELECT *, CASE WHEN amount < lag(amount) OVER (PARTITION BY sender_wallet ORDER BY timestamp, ord) THEN 0 ELSE 1 END AS brk FROM tx_w)) GROUP BY 1, 2) GROUP BY 1""")


@query("win7", WIN7)
def win7(spark, d):
    return peel_chain(trailing_hours(transfers(spark, d)))


@query("win7_all", WIN7.replace("FROM tx_w)", "FROM tx_a)"))
def win7_all(spark, d):
    """Peel runs over the whole history, with split groups."""
    return peel_chain(transfers(spark, d), hot_rows=17)


SYNC = """(SELECT *, count(*) OVER (PARTITION BY receiver_wallet ORDER BY timestamp
  RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND INTERVAL 60 SECOND FOLLOWING) AS near FROM tx_{s})"""


@query("win8", select(S(wallet="sender_wallet"), I(synchronized_transfer_score="count(*) FILTER (near >= 2)"), tail=f"FROM {SYNC.format(s='w')} GROUP BY 1"))
def win8(spark, d):
    return synchronised_score(synchronised_sends(trailing_hours(transfers(spark, d))))


@query("joi7", select(S(transaction_id="a.transaction_id", synchronised="count(*) >= 2"), tail="""FROM tx_a a JOIN tx_a b ON b.receiver_wallet = a.receiver_wallet
  AND b.timestamp BETWEEN a.timestamp - INTERVAL 60 SECOND AND a.timestamp + INTERVAL 60 SECOND GROUP BY 1"""))
def joi7(spark, d):
    """Range self-join over all transfers, answered from nearest neighbours in time."""
    return synchronised_sends(transfers(spark, d)).select("transaction_id", "synchronised")


BURSTY = f"""(SELECT *, CASE WHEN count(*) OVER (PARTITION BY sender_wallet) >= 3 THEN stddev_pop(gap / 1e6) OVER (PARTITION BY sender_wallet) ELSE 0 END AS burst FROM {GAPS})"""


@query("win9", select(S(wallet="wallet"), I(n="count(*)", sent="sum(is_sender)"), D(amount="sum(amount)", gap="sum(gap) / 1e6", burst="round(sum(burst), 2)"), tail=f"""
FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY timestamp DESC, ord DESC) AS r FROM (
  SELECT sender_wallet AS wallet, timestamp, ord, amount, coalesce(gap, 0) AS gap, burst, 1 AS is_sender FROM {BURSTY}
  UNION ALL SELECT receiver_wallet, timestamp, ord, amount, coalesce(gap, 0), burst, 0 FROM {BURSTY} WHERE sender_wallet <> receiver_wallet)) WHERE r <= 50 GROUP BY 1"""))
def win9(spark, d):
    """The last fifty transfers per wallet, summed up."""
    return sequence_rows(tf.transaction_features(transfers(spark, d), Settings()), 50).groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_sender").cast("bigint").alias("sent"), F.sum("amount").alias("amount"), F.sum("time_since_prev_out").alias("gap"),
        F.round(F.sum("burstiness_score"), 2).alias("burst"),
    )


WINDOW_PARTS = {
    "hop_count_in_window": "gra7", "fragmentation_score": "gra8", "fund_splitting_entropy": "gra8", "peel_chain_score": "win7",
    "velocity_score": "gra9", "synchronized_transfer_score": "win8",
}
_JOINED = {**{q: ORACLES[q] for q in sorted(set(WINDOW_PARTS.values()) & set(ORACLES))}, "win7": WIN7, "reconv": reconvergence_sql("w"),
           "circ": sql("SELECT wallet, count(*) AS circularity_score FROM (SELECT unnest(path) AS wallet FROM walk WHERE closed) GROUP BY 1", walk=cycle_walk("w"))}
GRA10 = ("SELECT a.wallet, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in [*WINDOW_PARTS, "reconvergence_score", "circularity_score"])
         + " FROM (" + sql("SELECT sender_wallet AS wallet FROM tx_w UNION SELECT receiver_wallet FROM tx_w") + ") a "
         + " ".join(f"LEFT JOIN ({statement}) {name} USING (wallet)" for name, statement in _JOINED.items()))


@query("gra10", GRA10)
def gra10(spark, d):
    """All eight window metrics per active wallet."""
    f = window_features(transfers(spark, d))
    return f.select("wallet", *[F.col(c).cast("double").alias(c) for c in f.columns if c != "wallet"])


@query("win10", sql("SELECT wallet, peel_edges, peel_drops FROM pe_a"))
def win10(spark, d):
    return peel_edges(wallet_edges(transfers(spark, d)))


def scored_labels(spark, d):
    """Document quality labels with a score derived from the document length."""
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "n_chars")
    score = ((F.col("n_chars") * 37 + F.col("quality") * 300) % 1000) / 1000.0
    return lab.join(doc, "doc_id").select("doc_id", F.col("quality").alias("y"), score.alias("p"))


SCORED = "(SELECT doc_id, quality AS y, ((n_chars * 37 + quality * 300) % 1000) / 1000.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"
CURVE = f"""SELECT p AS threshold, pos, cnt, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(cnt) OVER (ORDER BY p DESC) AS predicted,
  sum(pos) OVER () AS total FROM (SELECT p, sum(y) pos, count(*) cnt FROM {SCORED} GROUP BY 1)"""


@query("win11", select(I(tp="tp", predicted="predicted"), D(threshold="threshold", precision="tp / predicted", recall="tp / total"), tail=f"FROM ({CURVE})"))
def win11(spark, d):
    return precision_recall_points(scored_labels(spark, d), "y", "p").select("threshold", "tp", "predicted", "precision", "recall")


@query("win11_split", select(I(tp="tp", predicted="predicted"), D(threshold="threshold"), tail=f"FROM ({CURVE})"))
def win11_split(spark, d):
    return precision_recall_points(scored_labels(spark, d), "y", "p", hot_rows=40).select("threshold", "tp", "predicted")


def runs_table(spark, d):
    """One run per day of transfers with its counts; every fourth day is still running."""
    t = transfers(spark, d)
    day = F.date_trunc("day", "timestamp")
    r = t.groupBy(day.alias("created_at")).agg(
        F.count(F.lit(1)).alias("total_txns"), F.count_if(F.col("label") == "illicit").alias("suspicious_tx_count"),
        F.countDistinct("asset_type").alias("cluster_count"),
    )
    return r.select(
        F.concat(F.lit("run-"), F.date_format("created_at", "yyyyMMdd")).alias("run_id"), "*",
        F.when(F.dayofmonth("created_at") % 4 == 0, "running").otherwise("completed").alias("status"),
    )


RUNS = """(SELECT 'run-' || strftime(date_trunc('day', timestamp), '%Y%m%d') AS run_id, date_trunc('day', timestamp) AS created_at, count(*) AS total_txns,
  count(*) FILTER (label = 'illicit') AS suspicious_tx_count, count(DISTINCT asset_type) AS cluster_count,
  CASE WHEN day(any_value(timestamp)) % 4 = 0 THEN 'running' ELSE 'completed' END AS status FROM tx_a GROUP BY 1, 2)"""


@query("win12", select(S(run_id="run_id"), I(total_txns="total_txns"), tail=f"FROM {RUNS} WHERE status = 'completed' ORDER BY created_at DESC LIMIT 12"))
def win12(spark, d):
    """Series of the last twelve completed runs."""
    return paging.latest(runs_table(spark, d).where(F.col("status") == "completed"), "created_at", 12).select("run_id", "total_txns")


@query("agg14", select(I(total_runs="count(*)", completed_runs="count(*) FILTER (status = 'completed')", total_txns="sum(total_txns)", suspicious_txns="sum(suspicious_tx_count)",
                         clusters="sum(cluster_count)"), S(latest_completed="arg_max(run_id, created_at) FILTER (status = 'completed')"), tail=f"FROM (FROM {RUNS} ORDER BY created_at DESC LIMIT 200)"))
def agg14(spark, d):
    return paging.dashboard(runs_table(spark, d))


@query("top1", select(S(transaction_id="transaction_id"), T(timestamp="timestamp"), I(total="(SELECT count(*) FROM tx_a)"), tail="FROM tx_a ORDER BY timestamp DESC, ord LIMIT 25 OFFSET 50"))
def top1(spark, d):
    """Third page of transfers, newest first, with the exact total."""
    return paging.page(transfers(spark, d), [F.col("timestamp").desc(), F.col("ord")], 3, 25).select("transaction_id", "timestamp", "total")


@query("top7", sql("""SELECT sender_wallet, asset_type FROM (SELECT sender_wallet, asset_type, row_number() OVER (PARTITION BY sender_wallet ORDER BY count(*) DESC, asset_type) r
FROM tx_a GROUP BY 1, 2) WHERE r = 1"""))
def top7(spark, d):
    """Most common asset type per sender, ties to the smallest."""
    return most_common(transfers(spark, d), ["sender_wallet"], "asset_type", "asset_type")


FEATS = ["log_amount", "fee_ratio", "time_since_prev_out", "time_since_prev_in", "burstiness_score", "amount_deviation"]


@query("txfeatures", select(S(transaction_id="transaction_id", is_round_amount="amount % 10 = 0"), I(sender_tx_count="count(*) OVER (PARTITION BY sender_wallet)",
       receiver_tx_count="count(*) OVER (PARTITION BY receiver_wallet)", sender_repeat_count="row_number() OVER (PARTITION BY sender_wallet, receiver_wallet ORDER BY timestamp, ord)"),
       D(log_amount="ln(1 + greatest(amount, 0))", fee_ratio="CASE WHEN amount <> 0 THEN fee / amount ELSE 0 END", time_since_prev_out="coalesce(gap, 0) / 1e6",
         time_since_prev_in="coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY receiver_wallet ORDER BY timestamp, ord), 0) / 1e6",
         burstiness_score="round(CASE WHEN count(*) OVER (PARTITION BY sender_wallet) >= 3 THEN stddev_pop(gap / 1e6) OVER (PARTITION BY sender_wallet) ELSE 0 END, 3)",
         amount_deviation="CASE WHEN sd > 0 THEN (amount - mu) / sd ELSE 0 END"), tail=f"""
FROM (SELECT *, avg(amount) OVER w AS mu, stddev_pop(amount) OVER w AS sd FROM {GAPS}
WINDOW w AS (PARTITION BY sender_wallet ORDER BY timestamp, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def txfeatures(spark, d):
    """The full per-transfer feature table."""
    f = tf.transaction_features(transfers(spark, d), Settings()).withColumn("burstiness_score", F.round("burstiness_score", 3))
    return f.select("transaction_id", "is_round_amount", "sender_tx_count", "receiver_tx_count", "sender_repeat_count", *FEATS)
