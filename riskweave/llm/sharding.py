"""Shards by jump consistent hashing: no ring table, and a new shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from .common import replaced, written

STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to shards - 1) of each unsigned 64-bit key: the last jump target below ``shards``."""
    key = keys.astype(np.uint64, copy=True)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = ahead < shards
    with np.errstate(over="ignore"):
        while going.any():
            at[going] = ahead[going]
            key[going] = key[going] * STEP + np.uint64(1)
            draw = ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead[going] = ((at[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            going = ahead < shards
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Column of shard numbers for a bigint key column without nulls."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return of(key)


def stable_key(col: Column, kind: str) -> Column:
    """A bigint that depends on the key's value alone: whole numbers stand for themselves, other types for 64 bits of their hash."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.coalesce(col.cast("bigint"), F.lit(-1).cast("bigint"))
    return F.xxhash64(F.coalesce(col.cast("string"), F.lit("")))


def shard(docs: DataFrame, *, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law`` (``key``), ``shard`` and ``grown_shard``.

    The key and the number of shards alone decide, so copies of a row go together and a
    rerun agrees. ``grown_shard`` is the shard if there were one more. A null key counts
    as -1, a null text has size 1 and the checksum of the empty text, an empty table stays
    empty; input columns with one of the five names are replaced. No shuffle.
    """
    k = stable_key(F.col(f"`{key}`"), dict(docs.dtypes)[key])
    t = F.col(f"`{text}`")
    return replaced(docs, {
        "size": (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce(t, F.lit("")).cast("binary")),
        "law": F.lit("key"),
        "shard": shard_of(k, shards),
        "grown_shard": shard_of(k, shards + 1),
    })


def with_slots(rows: DataFrame, *, key: str = "doc_id", pieces: int = 1024) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each shard, ordered by (key modulo ``pieces``, key, checksum, size).

    A shard is numbered in pieces: each piece is sorted by itself and starts where the
    pieces before it end, so no task holds a whole shard. Rows equal in all of these are
    interchangeable; null keys count as -1. ``rows`` is what ``shard`` returns; take
    only narrow columns along, as they are shuffled.
    """
    k = stable_key(F.col(f"`{key}`"), dict(rows.dtypes)[key])
    kept = written(rows.withColumn("_key", k).withColumn("_piece", F.pmod("_key", F.lit(pieces)).cast("int")))
    upto = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = kept.groupBy("shard", "_piece").count().select(
        F.col("shard").alias("_s"), F.col("_piece").alias("_p"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_piece").orderBy("_key", "text_crc32", "size")
    numbered = kept.withColumn("_n", F.row_number().over(inside))
    slot = (F.col("_start") + F.col("_n") - 1).cast("long")
    joined = numbered.join(start, (F.col("shard") == F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return replaced(joined, {"slot": slot}).drop("_s", "_p", "_start", "_n", "_key", "_piece")
