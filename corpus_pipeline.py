"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that
is written and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import decontaminate, mixing, neardup, quality, sharding
from riskweave.llm.common import table, written
from riskweave.session import prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all labels, doesn't reject."""
    prepare(spark)
    return quality.good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the smallest id, once if its row is repeated."""
    prepare(spark)
    return neardup.deduplicated(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken."""
    prepare(spark)
    return mixing.mixed(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard of eight, and the shard if there were nine."""
    prepare(spark)
    return sharding.shard(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_clean),
    ("mixing", mix),
    ("sharding", place),
]
#: SQL can express neither the trained classifier nor the sketches; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
