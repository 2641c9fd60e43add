"""Run-keyed Parquet tables: append, read, upsert, exports and shuffled file cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..session import cut_lineage


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """SNK1: append rows stamped with their run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """SRC4: read a run's rows; the filter prunes partitions."""
    df = spark.read.parquet(path)
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def _last(new: DataFrame, key: list[str], order: Sequence[str] | None) -> DataFrame:
    """Among rows that repeat a key the last by ``order``."""
    if not order:
        return new
    rest = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*new.columns)


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """SNK2: rows of ``new`` replace rows of ``target`` with the same key; among repeats in ``new`` the last wins."""
    key = list(key)
    new = _last(new, key, order)
    return target.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_table(path: str, new: DataFrame, key: Sequence[str], order: Sequence[str] | None = None, buckets: int = 64) -> None:
    """SNK2: the same on a stored table, which is made when it is missing.

    Rows lie in ``buckets`` folders by a hash of the key. Only buckets that ``new`` has keys of are read and replaced, all of them by
    one commit; files of the others stay as they are. The number of buckets is part of the folders' name, and a table
    keeps the one it was made with.
    """
    spark, key = new.sparkSession, list(key)
    place = f"bucket_of_{buckets}"
    rows = cut_lineage(_last(new, key, order).withColumn(place, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.repartition(place).write.partitionBy(place).parquet(path)
        return
    if place not in old.columns:
        raise ValueError(f"{path} isn't kept in {buckets} buckets")
    touched = [r[0] for r in rows.select(place).distinct().collect()]
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    kept = old.where(F.col(place).isin(touched)).alias("o").join(rows.select(*key).alias("n"), same, "left_anti")
    whole = cut_lineage(kept.unionByName(rows, allowMissingColumns=True))
    whole.repartition(place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(place).parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table kept by ``upsert_table``."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith("bucket_of_")])


def export_csv(df: DataFrame, path: str) -> None:
    """SNK3: CSV with header, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def shuffled_slices(df: DataFrame, key: str, seed: int, rows_per_file: int, hot_rows: int | None = None) -> DataFrame:
    """SNK4: a seeded shuffle cut into numbered slices of at most ``rows_per_file`` rows."""
    mixed = df.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    placed = ordered_scan(mixed, [], ["_h", key], index="_i", hot_rows=hot_rows)
    return placed.withColumn("slice", F.floor((F.col("_i") - 1) / rows_per_file).cast("int")).drop("_h", "_i")


def write_slices(df: DataFrame, path: str) -> None:
    """SNK4: one folder per slice."""
    df.repartition("slice").write.mode("overwrite").partitionBy("slice").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """SNK5: one JSON document per row."""
    df.write.mode("overwrite").json(path)


def read_training_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SRC6: the training tables that exist, Parquet preferred over CSV.

    ``val_features`` and ``offramp_features`` fall back to ``train_features``.
    """

    def load(name: str) -> DataFrame | None:
        readers = [lambda: spark.read.parquet(f"{folder}/{name}.parquet"), lambda: spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)]
        for read in readers:
            try:
                return read()
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return None

    train = load("train_features")
    if train is None:
        raise FileNotFoundError(f"{folder} holds no train_features table")
    out = {"train_features": train}
    for name in ("edges", "node_labels", "wallet_labels"):
        found = load(name)
        if found is not None:
            out[name] = found
    for name in ("val_features", "offramp_features"):
        found = load(name)
        out[name] = train if found is None else found
    return out
