"""Mixing sources to target weights by Pareto order sampling after whole copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import inner_names, uniform, words_in, written


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(src, source_size, target) per source from (src, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share all
    sizes; none gets more than ``cap`` times its own, the excess going to the others by
    weight. That is ``least(weight * level, cap * size)`` for one level, found where the
    sources sorted by ``cap * size / weight`` stop being held by their caps. One row per source
    reaches the window's task.
    """
    per = sizes.groupBy("src").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int") + 1)
    per = per.select("src", "source_size", weigh.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    every = Window.partitionBy()
    rise = Window.orderBy(F.col("most") / F.col("w"), F.col("src").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumns({
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), zero))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero)),
        "place": F.row_number().over(rise),
    })
    free = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("place", "level"))
    per = per.withColumn("level", F.min(free).over(every).getField("level"))
    target = F.coalesce(F.least(F.col("w") * F.col("level"), F.col("most")), F.col("most"))
    return per.select("src", "source_size", target.alias("target"))


def drawn(rows: DataFrame, seed: str, pieces: int) -> DataFrame:
    """Adds the Pareto rank value: odds of a random number over the inclusion odds of the row's source, and its piece."""
    u, p = uniform(seed, F.col("id")), F.col("share")
    odds = u / (1 - u) * ((1 - p) / p)
    rows = rows.withColumn("rank_value", F.when(p > 0, odds))
    part = F.least(F.floor(F.col("rank_value") / (1 + F.col("rank_value")) * pieces), F.lit(pieces - 1))
    return rows.withColumn("piece", part.cast("long"))


def plan(docs: DataFrame, *, weights=(5, 2, 1), cap=3, seed="mix", pieces=1024, id="doc_id", text="text", source="source"):
    """(sized rows, cuts): one row per document, and one row per source with whole copies, share and the last document drawn."""
    sized = written(inner_names(docs, {"id": id, "src": source, "t": text}).select("id", "src", words_in(F.col("t")).alias("size")))
    goal = written(_shares(targets(sized, weights, cap)))
    named = goal.select(F.col("src").alias("src_"), "share", "rest")
    ranked = drawn(sized.join(named, F.col("src").eqNullSafe(F.col("src_"))).drop("src_"), seed, pieces).where("share > 0")

    # Words per piece of each source's order, then the piece in which the share is used up.
    upto = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    per = ranked.groupBy("src", "piece").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    per = per.withColumn("earlier", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = per.where("earlier <= rest").groupBy("src").agg(F.max_by(F.struct("piece", "earlier"), "piece").alias("e"))
    edge = written(edge.select(F.col("src").alias("src_"), F.col("e.piece").alias("edge"), F.col("e.earlier").alias("earlier")))

    # Inside that piece alone: documents in order while their middle lies within the share.
    near = ranked.join(edge, F.col("src").eqNullSafe(F.col("src_")) & (F.col("piece") == F.col("edge")))
    order = Window.partitionBy("src").orderBy("rank_value", F.col("id").asc_nulls_first())
    middle = F.col("earlier") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2
    last = near.withColumn("middle", middle).where("middle <= rest").groupBy("src").agg(F.max(F.struct("rank_value", "id")).alias("last"))
    last = last.select(F.col("src").alias("src_"), "last")
    edge = edge.select(F.col("src_").alias("src_e"), "edge")
    cuts = goal.join(edge, F.col("src").eqNullSafe(F.col("src_e")), "left").drop("src_e")
    cuts = cuts.join(last, F.col("src").eqNullSafe(F.col("src_")), "left").drop("src_", "rest")
    return sized, written(cuts)


def _shares(goal: DataFrame) -> DataFrame:
    """Whole copies, and the share and the words left to be drawn."""
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(times).cast("long")).withColumn("share", times - F.col("whole"))
    return goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def applied(rows: DataFrame, cuts: DataFrame, seed: str, pieces: int) -> DataFrame:
    """(id, src, size) rows with source_size, target, copies and taken words. ``cuts`` has one row per source."""
    c = cuts.select(F.col("src").alias("src_"), "source_size", "target", "whole", "share", "edge", "last")
    got = drawn(rows.join(c, F.col("src").eqNullSafe(F.col("src_")), "left").drop("src_"), seed, pieces)
    mine = F.struct("rank_value", "id")
    chosen = (F.col("piece") < F.col("edge")) | ((F.col("piece") == F.col("edge")) & F.col("last").isNotNull() & (mine <= F.col("last")))
    copies = (F.col("whole") + F.when(chosen, 1).otherwise(0)).cast("long")
    return got.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("rank_value", "piece", "whole", "share", "edge", "last")


def mixture(docs: DataFrame, *, weights=(5, 2, 1), cap=3, seed="mix", pieces=1024, **cols) -> DataFrame:
    """Per document: id, src, size, source_size, target, copies, taken.

    Every document of a source gets the whole part of target over size as copies. The
    broken part is drawn: documents are ranked by the odds of their random number over
    their inclusion odds, and taken in that order until the words still missing
    are reached, so a source ends within half a document of its target. Random numbers
    come from seed and id alone, so reruns agree. Rows that share id and source share
    the draw. Null text: size 0; null source: a source of its own, last; null
    id: an id of its own; an empty table gives an empty one; other columns play no part.
    """
    sized, cuts = plan(docs, weights=weights, cap=cap, seed=seed, pieces=pieces, **cols)
    return applied(sized, cuts, seed, pieces)


def mixed(docs: DataFrame, *, weights=(5, 2, 1), cap=3, seed="mix", pieces=1024, id="doc_id", text="text", source="source") -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with their own columns. Texts aren't shuffled."""
    _, cuts = plan(docs, weights=weights, cap=cap, seed=seed, pieces=pieces, id=id, text=text, source=source)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    field = {c.lower(): c for c in docs.columns}
    get = lambda c: F.col("row").getField(field[c.lower()]) if c.lower() in field else F.lit(None).cast("string")
    rows = rows.select("row", get(id).alias("id"), get(source).alias("src"), words_in(get(text)).alias("size"))
    got = applied(rows, cuts, seed, pieces)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return got.where("copies > 0").select("row", times.alias("nth")).select("row.*")

