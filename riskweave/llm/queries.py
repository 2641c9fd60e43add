"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..session import prepare
from . import conversations, decontaminate, extraction, lm, mixing, neardup, neighbours, quality, search, sharding, statements, tokens, toxicity, urls
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1_toxicity(spark, d):
    """Every document's toxicity, learned from the labels of two folds in three."""
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"), lambda i: ~held_out(i, 3))
    got = toxicity.toxicity(docs, model)
    return got.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3).alias("held_out"), "score", "predicted")


@query("op2_mix", statements.MIX)
def op2_mix(spark, d):
    """All documents with what the mix takes of each."""
    return mixing.mixture(table(spark, d, "documents")).select(
        "id", "size", "source_size", "target", "taken", "copies"
    ).withColumnRenamed("id", "doc_id")


@query("op3_extract")
def op3_extract(spark, d):
    """The main text of every page."""
    pages = table(spark, d, "pages")
    return extraction.extract(pages, extraction.train(pages)).withColumnRenamed("id", "page_id")


def _piece_model() -> tokens.PieceCounter:
    import public_tokenizers

    return tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_tokens")
def op4_tokens(spark, d):
    """Token counts of every document."""
    return tokens.count_tokens(table(spark, d, "documents"), _piece_model).withColumnRenamed("id", "doc_id")


@query("op5_decontaminate", statements.DECONTAMINATE)
def op5_decontaminate(spark, d):
    """Every document's words in windows of benchmark items."""
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op6_neardup")
def op6_neardup(spark, d):
    """Every document's component of near copies at a similarity of 0.85."""
    got = neardup.near_duplicates(table(spark, d, "documents"), threshold=0.85)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op7_nearest")
def op7_nearest(spark, d):
    """The five nearest rows of every fiftieth vector."""
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("id") % 50 == 0)


@query("op8_lm")
def op8_lm(spark, d):
    """Every document's score under a model of the texts of four folds in five."""
    docs = table(spark, d, "documents")
    got = lm.scored(docs, ~held_out(F.col("id"), 5))
    id = F.col("id")
    return got.select(id.alias("doc_id"), held_out(id, 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op9_quality")
def op9_quality(spark, d):
    """Every document's evidence, site mean and posterior of good quality, learned from the labels of two folds in three."""
    docs = table(spark, d, "documents")
    weights = quality.train(docs, table(spark, d, "labels"), lambda i: ~held_out(i, 3))
    got = quality.score(docs, weights)
    id = F.col("row.doc_id")
    return got.select(id.alias("doc_id"), held_out(id, 3).alias("held_out"), "evidence", "site", "posterior", (F.col("posterior") >= 0.5).alias("kept"))


@query("op10_shard")
def op10_shard(spark, d):
    """All documents with shard, slot, and the shard if there were one more."""
    rows = sharding.shard(table(spark, d, "documents"))
    return sharding.with_slots(rows.select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard"))


@query("op11_trie", statements.CONVERSATIONS)
def op11_trie(spark, d):
    """Every node of the conversations' prefixes; up to three first turns are those of the conversation that begins a score of ids."""
    turns = conversations.sequenced(table(spark, d, "conversations"))
    c = F.col("conv")
    base, heads = c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4
    return conversations.prefix_trie(*conversations.joined_heads(turns, base, heads, 3))


@query("op12_search", statements.SEARCH)
def op12_search(spark, d):
    """The ten highest-scoring documents of each benchmark item."""
    got = search.search(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return got.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


#: The entries of the query's contract.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op13_urls", statements.URLS)
def op13_urls(spark, d):
    """The verdict on every page's url."""
    return urls.judged(table(spark, d, "pages"), URL_RULES).withColumnRenamed("id", "page_id")
