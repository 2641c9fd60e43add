"""Shared helpers: words, hashes, scratch tables, schema care."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: White space of the word contracts: space and the controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
#: A word is a longest run of anything else.
WORD = rf"[^{SPACE}]+"
#: Bytes at which an Arrow batch on its way to Python is closed.
BATCH_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that it has a known size and no lineage."""
    return cut_lineage(df)


def in_arrow(df: DataFrame, run, schema: str, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` with batches of at most ``rows`` rows and ``BATCH_BYTES`` of data, so that long texts don't fill a worker.

    Both are settings of the session, read when the plan runs: a later call may change the rows, never the bytes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with the given columns; input columns of those names (in any case) give way to them."""
    names = {k.lower() for k in new}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[c.alias(k) for k, c in new.items()])


def inner_names(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, under names of our own; an absent column becomes null text."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None).cast("string")).alias(k) for k, c in wanted.items()])


def words_in(text: Column) -> Column:
    """Number of white-space-separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the seed and the keys alone."""
    told = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("~")) for k in keys])
    return (F.conv(F.substring(F.md5(told), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def struct_key(cols: Sequence[str]) -> Column:
    """The columns as one value in which nulls compare equal."""
    return F.struct(*[F.col(c) for c in cols])
