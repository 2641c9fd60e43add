"""Session helpers: settings the operators rely on and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "riskweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone (all timestamps are UTC) and make a checkpoint folder known.

    Generated methods beyond 8,000 bytes are never compiled by HotSpot, which wide tables and the rules run into;
    Spark then cuts them up, unless the caller set another limit.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Later steps neither recompute it nor depend on any one executor. Parquet keeps
    column pruning and known sizes, and, unlike ``checkpoint()``, the plan is run
    once and hands no growing set of inferred constraints to the next iteration.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/riskweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
