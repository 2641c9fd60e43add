"""Nearest neighbours along several shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, inner_names, written

CURVES, DIMS, BITS = 24, 8, 7
#: Neighbours of so many sample queries are found by brute force, to set the window and to measure recall.
SAMPLE = 150
#: Rows of a curve compared with queries in one piece of work.
BLOCK = 1024


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer point (a row) on the Hilbert curve through ``bits`` bits per axis."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            here = (x[i] & q) > 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(here, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) with doubles, without vectors that are null, zero, of another length than most or hold null or non-finite parts."""
    got = inner_names(rows, {"id": id, "v": vector}).select("id", F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    got = got.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    size = got.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return got.where(F.size("v") == (size[0] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def curves_of(vectors: DataFrame, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per curve a projection, and the offset and scale that put the projected vectors, randomly shifted, into the unit cube."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column("v")))
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    parts = in_arrow(vectors.select("v"), moments, "n bigint, s array<double>, ss array<double>").coalesce(64)
    total = None
    for r in parts.toLocalIterator():
        own = (r["n"], np.array(r["s"]), np.array(r["ss"]))
        total = own if total is None else tuple(a + b for a, b in zip(total, own))
    if total is None:
        return []
    n, s, ss = total
    mean, d = s / n, len(s)
    cov = ss.reshape(d, d) / n - np.outer(mean, mean)
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(CURVES):
        p = np.linalg.qr(draw.normal(size=(d, d)))[0][:, : min(DIMS, d)]
        spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", p, cov, p), 1e-12))
        shift = draw.uniform(-0.2, 0.2, p.shape[1])
        out.append((p, mean @ p - (0.5 + shift) * 4 * spread, 4 * spread))
    return out


def ranked(vectors: DataFrame, seed: int) -> DataFrame:
    """(curve, rank, id): every vector's place, from 0, on every curve. Curves are range-partitioned by key."""
    curves = curves_of(vectors, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column("v")))
            for c, (p, low, size) in enumerate(curves):
                y = np.clip((x @ p - low) / size, 0, 1 - 1e-9)
                key = hilbert((y * (1 << BITS)).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), b.column("id")], ["curve", "key", "id"])

    kind = vectors.schema["id"].dataType.simpleString()
    keyed = in_arrow(vectors, run, f"curve int, key bigint, id {kind}")
    parts = max(CURVES, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = written(keyed.repartitionByRange(parts, "curve", "key", "id").withColumn("piece", F.spark_partition_id()))
    upto = Window.partitionBy("curve").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begin = pieces.groupBy("curve", "piece").count().select(F.col("curve").alias("c"), F.col("piece").alias("p"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("begin"))
    numbered = pieces.withColumn("n", F.row_number().over(Window.partitionBy("curve", "piece").orderBy("key", "id")))
    joined = numbered.join(begin, (F.col("curve") == F.col("c")) & (F.col("piece") == F.col("p")))
    return written(joined.select("curve", (F.col("begin") + F.col("n") - 1).alias("rank"), "id"))


def best(query: np.ndarray, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the k nearest; ``rough`` thins, then every cosine is computed in one fixed way so that ties are ties."""
    rough = np.where(ids == own, -np.inf, rough)
    some = np.flatnonzero(rough > -np.inf)
    if len(some) > k:
        some = some[rough[some] >= np.partition(rough[some], -k)[-k] - 1e-9]
    got = x[some]
    score = (got * query).sum(1) / (np.sqrt((got * got).sum(1)) * np.sqrt((query * query).sum()))
    order = np.lexsort((ids[some], -score))
    fresh = order[np.unique(ids[some][order], return_index=True)[1]] if len(np.unique(ids[some])) < len(some) else order
    fresh = fresh[np.lexsort((ids[some][fresh], -score[fresh]))][:k]
    return ids[some][fresh], score[fresh]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per query of (query_id, vec_id, score) rows."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute(vectors: DataFrame, ids: list, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the given queries against all vectors; ``ids`` is bounded by the caller."""
    sent = vectors.where(F.col("id").isin(ids)).dropDuplicates(["id"]).collect() if ids else []
    queries = [(r["id"], np.array(r["v"])) for r in sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and queries:
                x, i = matrix(b.column("v")), b.column("id").to_numpy()
                rough = unit(np.stack([v for _, v in queries])) @ unit(x).T
                got = [best(v, i, x, rough[n], q, k) for n, (q, v) in enumerate(queries)]
                yield _found([q for q, _ in queries], got)

    return _top(in_arrow(vectors, run, "query_id bigint, vec_id bigint, score double"), k)


def _found(ids: list, got: list) -> pa.RecordBatch:
    q = np.repeat(np.array(ids, np.int64), [len(i) for i, _ in got])
    v = np.concatenate([i for i, _ in got]).astype(np.int64) if got else np.zeros(0, np.int64)
    s = np.concatenate([s for _, s in got]) if got else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])


def window_for(places: DataFrame, truth: DataFrame, recall: float) -> tuple[int, int]:
    """(window, sampled pairs): the smallest distance along the nearest curve that reaches the share of true neighbours."""
    t = truth.select("query_id", "vec_id")
    q = t.join(places.select(F.col("id").alias("query_id"), "curve", F.col("rank").alias("rq")), "query_id")
    both = q.join(places.select(F.col("id").alias("vec_id"), "curve", F.col("rank").alias("rv")), ["vec_id", "curve"])
    near = both.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("rq") - F.col("rv"))).alias("d"))
    d = np.sort([r["d"] for r in near.collect()])
    return (int(d[min(len(d) - 1, int(np.ceil(recall * len(d))) - 1)]), len(d)) if len(d) else (1, 0)


def nearest(rows: DataFrame, is_query: Column, *, k: int = 5, recall: float = 0.96, id: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by cosine of the original vectors.

    ``is_query`` is a condition on the column ``id``. Vectors are projected at random and put on shifted Hilbert
    curves; all rows within a window of places around the query on any curve are compared in
    full. The window is the one that finds the share ``recall`` of the true neighbours of a
    bounded sample of queries, so it follows how hard the vectors are: it is a few rows where
    they lie on a thin shape, and a good part of the table where they fill all dimensions.
    Ties go to the smaller id; repeated ids count once; rows that take no part (see ``usable``) are neither queries nor
    found; fewer rows than k give as many as there are; an empty table gives none. Ids are whole numbers.
    """
    vectors = written(usable(rows, id, vector))
    places = ranked(vectors, seed)
    queries = vectors.where(is_query)
    ids = [r["id"] for r in queries.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    window, _ = window_for(places, brute(vectors, ids, k), recall)
    block = min(BLOCK, max(64, window))

    placed = places.join(vectors, "id").select("curve", "rank", "id", "v")
    at = (F.col("rank") / block).cast("long")
    base = placed.select("curve", at.alias("block"), F.lit(False).alias("asks"), "rank", "id", "v")
    reach = F.sequence((F.greatest(F.col("rank") - window, F.lit(0)) / block).cast("long"), ((F.col("rank") + window) / block).cast("long"))
    asking = placed.where(is_query).select("curve", F.explode(reach).alias("block"), F.lit(True).alias("asks"), "rank", "id", "v")
    both = base.unionAll(asking).repartition("curve", "block").sortWithinPartitions("curve", "block", "asks")

    def compare(t: pd.DataFrame) -> pa.RecordBatch | None:
        asks = t["asks"].to_numpy(bool)
        if asks.all() or not asks.any():
            return None
        v = np.stack(t["v"].to_numpy())
        i, r = t["id"].to_numpy(), t["rank"].to_numpy()
        x, q = v[~asks], v[asks]
        rough = unit(q) @ unit(x).T
        rough[np.abs(r[asks][:, None] - r[~asks][None, :]) > window] = -np.inf
        return _found(i[asks].tolist(), [best(q[n], i[~asks], x, rough[n], own, k) for n, own in enumerate(i[asks])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = b.to_pandas()
            t = t if rest is None else pd.concat([rest, t], ignore_index=True)
            cuts = np.flatnonzero((t[["curve", "block"]] != t[["curve", "block"]].shift()).any(axis=1).to_numpy())
            for s, e in zip(cuts[:-1], cuts[1:]):
                if (got := compare(t.iloc[s:e])) is not None:
                    yield got
            rest = t.iloc[cuts[-1] :] if len(cuts) else t
        if rest is not None and len(rest) and (got := compare(rest)) is not None:
            yield got

    found = in_arrow(both, run, "query_id bigint, vec_id bigint, score double", 2000)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
