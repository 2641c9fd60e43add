"""Benchmark decontamination: an exact set join on rare words, with DataFrame operations only.

A window of an item occurs in a document where its rarest word occurs and the words
around it agree. So only that word, the window's necessary prefix in order of rarity, is
joined with the documents' words; its place in the window bounds where the window can start, and
the words between are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, inner_names, written

#: Runs of anything that is neither a digit, a letter a-z nor beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows are broadcast up to this many bytes of text; beyond, they are joined by shuffling.
BROADCAST_BYTES = 16 << 20


def word_list(text: Column) -> Column:
    """The words, with an empty string before (after) them where the text begins (ends) with a gap."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, -1)


def word_count(words: Column) -> Column:
    edges = (F.element_at(words, 1) == "").cast("int") + ((F.element_at(words, -1) == "") & (F.size(words) > 1)).cast("int")
    return (F.size(words) - edges).cast("long")


def item_windows(items: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """(item, window) per item and run of ``width`` consecutive words; a shorter item that has words is one window."""
    rows = inner_names(items, {"item": id, "t": text}).select("item", F.filter(word_list(F.col("t")), lambda w: w != "").alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("n", F.least(F.lit(width), F.size("w")))
    start = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    return rows.select("item", "w", "n", start.alias("s")).select("item", F.slice("w", F.col("s"), F.col("n")).alias("window"))


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, words): rows that share id and text share a key, and so a result."""
    rows = inner_names(docs, {"id": id, "t": text})
    return rows.select("id", F.xxhash64(F.coalesce(F.col("t"), F.lit(""))).alias("h"), word_list(F.col("t")).alias("words"))


def anchors(windows: DataFrame, docs: DataFrame, fits: bool) -> DataFrame:
    """(window, anchor, offset) per distinct window: its rarest word over all documents, and where it stands."""
    distinct = windows.select("window").distinct()
    vocabulary = written(distinct.select(F.explode("window").alias("w")).distinct())
    seen = docs.select(F.explode("words").alias("word"))
    known = F.broadcast(vocabulary) if fits else vocabulary
    often = seen.join(known, F.col("word") == F.col("w")).groupBy("w").count()
    placed = distinct.select("window", F.posexplode("window").alias("offset", "anchor"))
    placed = placed.join(often, F.col("anchor") == F.col("w"), "left").drop("w")
    rank = F.struct(F.coalesce("count", F.lit(0)), "anchor", "offset")
    best = placed.groupBy("window").agg(F.min(rank).alias("r"), F.min(F.coalesce("count", F.lit(0))).alias("least"))
    # A word that no document has rules its window out.
    return best.where("least > 0").select("window", F.col("r.anchor").alias("anchor"), F.col("r.offset").alias("offset"))


def occurrences(docs: DataFrame, items: DataFrame, *, width: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): hits (id, h, start, window) of every place where a window occurs, and the windows (item, window).

    The windows are broadcast if their measured text is within ``broadcast_bytes``; a larger
    benchmark is joined by shuffling words, and candidates are verified against the documents
    joined by key. Both give the same rows.
    """
    windows = written(item_windows(items, width, item_id, item_text).distinct())
    fits = (windows.agg(F.sum(F.octet_length(F.array_join("window", " ")))).first()[0] or 0) <= broadcast_bytes
    rows = keyed(docs, id, text)
    anchor = written(anchors(windows, rows, fits))
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.size("window") <= F.size("words"))
    same = F.slice("words", start + 1, F.size("window")) == F.col("window")
    if fits:
        spots = rows.select("id", "h", "words", F.posexplode("words").alias("at", "word"))
        found = spots.join(F.broadcast(anchor), F.col("word") == F.col("anchor")).where(inside & same)
    else:
        spots = rows.select("id", "h", F.posexplode("words").alias("at", "word"))
        near = spots.join(anchor, F.col("word") == F.col("anchor")).select(F.col("id").alias("id_"), F.col("h").alias("h_"), "at", "offset", "window")
        whole = rows.dropDuplicates(["id", "h"])
        found = near.join(whole, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))).where(inside & same)
    return found.select("id", "h", start.alias("start"), "window").distinct(), windows


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    A word is hit if it lies in any occurrence of any item's window; overlapping
    occurrences count it once. ``items_sha256`` is the digest of the item ids with occurring windows, sorted
    as strings and joined by commas, of the empty string if there are none. Null and empty texts
    have no words and no hits; items without words have no windows; repeated rows each get their
    result; empty tables on either side hit nothing; other columns play no part.
    """
    hits, windows = occurrences(docs, items, **options)
    hits = written(hits)
    end = F.col("start") + F.size("window")
    spans = hits.select("id", "h", "start", end.alias("end")).groupBy("id", "h", "start").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("id", "h").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("id", "h", "window").distinct().join(windows, "window").select("id", "h", F.col("item").cast("string").alias("item")).distinct()
    names = named.groupBy("id", "h").agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    found = covered.join(names.withColumnsRenamed({"id": "id2", "h": "h2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    found = written(found.select(F.col("id").alias("id_"), F.col("h").alias("h_"), "n_hit", "n_items", "names"))
    id, text = options.get("id", "doc_id"), options.get("text", "text")
    rows = keyed(docs, id, text).select("id", "h", word_count(F.col("words")).alias("n_words"))
    got = rows.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return got.select("id", "n_words", n("n_hit"), n("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with their own columns.

    Null and empty texts hold no window and stay; rows that share id and text share their fate; an empty table stays empty; very
    long texts are searched whole; columns of any name pass through.
    """
    id, text = options.get("id", "doc_id"), options.get("text", "text")
    hits, _ = occurrences(docs, items, **options)
    bad = written(hits.select(F.col("id").alias("bad_id_"), F.col("h").alias("bad_h_")).distinct())
    h = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.join(bad, F.col(f"`{id}`").eqNullSafe(F.col("bad_id_")) & (h == F.col("bad_h_")), "left_anti")
