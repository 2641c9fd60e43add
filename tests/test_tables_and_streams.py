"""Upserts of stored tables, streams with closed windows, learned runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from riskweave.sources import store
from riskweave.streaming import jobs


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = {f"w{i}": float(i) for i in range(400)}
    store.upsert_table(path, spark.createDataFrame([*rows.items(), (None, -1.0)], "wallet string, score double"), ["wallet"], buckets=32)
    before = files(path)
    new = [("w3", 1000.0, 1), ("w3", 2000.0, 2), ("fresh", 5.0, 1), (None, -2.0, 1)]
    store.upsert_table(path, spark.createDataFrame(new, "wallet string, score double, ord int"), ["wallet"], ["ord"], buckets=32)
    got = {r.wallet: r.score for r in store.read_upserted(spark, path).collect()}
    assert got == rows | {"w3": 2000.0, "fresh": 5.0, None: -2.0}
    assert store.read_upserted(spark, path).count() == 402
    kept, touched = before & files(path), {os.path.dirname(f) for f in files(path) - before}
    assert len(touched) <= 3 and kept == {f for f in before if os.path.dirname(f) not in touched} and len(kept) > 20
    with pytest.raises(ValueError):
        store.upsert_table(path, spark.createDataFrame(new, "wallet string, score double, ord int"), ["wallet"], ["ord"], buckets=8)


def test_windows_come_out_once_when_they_close(spark, tmp_path):
    """Hourly files of a week; one row comes days late. Each closed window is written once and leaves the state."""
    schema = "sender_wallet string, receiver_wallet string, amount double, timestamp timestamp"
    rng, rows = random.Random(5), []
    folder = str(tmp_path / "in")
    t0 = 1_704_067_200
    for day in range(7):
        part = [(f"w{rng.randrange(4)}", "shop", float(rng.randrange(20_000)), t0 + 86_400 * day + rng.randrange(86_400)) for _ in range(30)]
        rows += part
        late = [("w0", "shop", 7.0, t0 + 60)] if day == 5 else []
        df = spark.createDataFrame(part + late, "sender_wallet string, receiver_wallet string, amount double, t long")
        df.withColumn("timestamp", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(folder)
    names = sorted(files(folder), key=os.path.getmtime)
    for i, f in enumerate(names):  # the source takes the oldest file first
        os.utime(f, (1_000_000 + 10 * i, 1_000_000 + 10 * i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = jobs.closed_windows(jobs.velocity_stream(stream, "2 hours", "6 hours", "6 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("window.start").alias("w"), "wallet", "n_tx", "volume").collect()
    want, end = {}, max(r[3] for r in rows) - 7200
    for s, r, a, t in rows:
        w = t - (t - t0) % 21_600
        if w + 21_600 <= end:
            for x in (s, r):
                n, v = want.get((w, x), (0, 0.0))
                want[w, x] = (n + 1, v + a)
    assert len(got) == len(want) and {(r.w, r.wallet): (r.n_tx, r.volume) for r in got} == want
    states = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in states) == len(want)
    assert sum(s["numRowsDroppedByWatermark"] for s in states) >= 1
    assert max(s["numRowsTotal"] for s in states) < len(want)


def test_latest_windows_have_the_unfinished_ones(spark, tmp_path):
    """Two files: the second changes a slot of the first, and no window is closed at the end; none is missing or counted twice."""
    schema = "sender_wallet string, receiver_wallet string, amount double, timestamp timestamp"
    t0, folder = 1_704_067_200, str(tmp_path / "in")
    parts = [[("a", "b", 5.0, t0 + 60), ("a", "b", None, t0 + 7200), ("c", None, 20_000.0, t0 + 86_400)], [("a", "b", 7.0, t0 + 120), ("b", "a", 1.0, t0 + 5 * 86_400)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, "sender_wallet string, receiver_wallet string, amount double, t long")
        df.withColumn("timestamp", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(folder)
        for f in files(folder):
            if os.path.getmtime(f) > 1_000_100:
                os.utime(f, (1_000_000 + 10 * i, 1_000_000 + 10 * i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = jobs.latest_result(jobs.velocity_stream(stream, "40 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = jobs.sliding(spark.read.parquet(str(tmp_path / "out"))).select("wallet", F.unix_seconds("window.start").alias("w"), "n_tx", "n_below", "volume").collect()
    want = {}
    for s, r, a, t in [x for part in parts for x in part]:
        for wallet in (s, r):
            for k in range(24):
                n, b, v = want.get((wallet, t - t % 3600 - 3600 * k), (0, 0, None))
                want[wallet, t - t % 3600 - 3600 * k] = (n + 1, b + int(a is not None and 0 < a < 10_000), v if a is None else a + (v or 0))
    assert len(got) == len(want) and {(r.wallet, r.w): (r.n_tx, r.n_below, r.volume) for r in got} == want
