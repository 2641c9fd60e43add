"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inner_names, written


def sample_labels(labels: DataFrame, id: str, target: str, most: int, keep) -> DataFrame:
    """At most ``most`` labelled ids per class, by hash of the id; conflicting labels of an id count as the larger one."""
    one = labels.select(F.col(id).alias("lid"), F.col(target).cast("int").alias("y")).where("lid IS NOT NULL AND y IN (0, 1)")
    one = one.where(keep(F.col("lid"))).groupBy("lid").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.col("lid").cast("string"))
    return written(one.where("y = 1").orderBy(order, "lid").limit(most).unionAll(one.where("y = 0").orderBy(order, "lid").limit(most)))


def sample_texts(docs: DataFrame, chosen: DataFrame, id: str, text: str, most_bytes: int) -> DataFrame:
    """The sampled documents' texts of up to ``most_bytes``, one per id. ``chosen`` is bounded, so it is broadcast."""
    rows = inner_names(docs, {"id": id, "t": text}).join(F.broadcast(chosen), F.col("id") == F.col("lid"))
    return written(rows.where(F.octet_length("t") <= most_bytes).groupBy("lid").agg(F.first("t").alias("t"), F.first("y").alias("y")))
