"""Near-duplicate groups: SetSketch bands find candidates, estimates thin them, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import setsketch as ss
from .common import in_arrow, inner_names, written
from .texts import mix, raw, slices

#: Estimates below the threshold by more than this are dropped: five standard errors of M registers.
MARGIN = 0.15
#: Members of a band, and shingles of all of them, compared in one piece of work; larger bands are cut into pairs of tiles.
TILE, TILE_SHINGLES = 512, 4_000_000
#: Up to so many documents (16 bytes each) are looked up by broadcasting their keys.
LOOKUP = 1_000_000


def sketched(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, n, same, regs) per row: set size, class (128 bits of the set) and registers."""
    rows = inner_names(docs, {"id": id, "t": text}).withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            first, sh = ss.shingles(batch.column("t"))
            n = np.diff(first)
            run0, run1 = np.zeros(len(sh) + 1, np.uint64), np.zeros(len(sh) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(sh, out=run0[1:])
                np.cumsum(mix(sh ^ np.uint64(0x5851F42D4C957F2D)), out=run1[1:])
                both = np.column_stack([r[first[1:]] - r[first[:-1]] for r in (run0, run1)])
            regs = ss.registers(first, sh)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n), _binary(both), _binary(regs)], ["id", "h", "n", "same", "regs"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, h bigint, n bigint, same binary, regs binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value per row of the matrix."""
    data = np.ascontiguousarray(rows).tobytes()
    size = rows.shape[1] * rows.itemsize
    at = (np.arange(len(rows) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(data)])


def banded(reps: DataFrame) -> DataFrame:
    """(key, band, cls, n): every class once per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = ss.bands(raw(b.column("regs"))[1].view(np.uint16).reshape(-1, ss.M)).view(np.int64)
                cls, n = (np.repeat(b.column(c).to_numpy(), ss.BANDS) for c in ("cls", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(ss.BANDS, dtype=np.int32), len(keys))), pa.array(cls), pa.array(n)], ["key", "band", "cls", "n"])

    return in_arrow(reps.select("cls", "n", "regs"), run, "key bigint, band int, cls bigint, n bigint")


def members(reps: DataFrame) -> DataFrame:
    """(key, band, cls, tiles) of every band with more than one class; of bands with the same members, the first.

    Rows of bands are shuffled once, to their key, where those alone in a band end. A band of many or large sets is to be cut into ``tiles``.
    """
    shared = banded(reps).withColumn("k", F.count("*").over(Window.partitionBy("key"))).where("k > 1")
    rows = written(shared)
    bands = rows.groupBy("key").agg(F.first("band").alias("band"), F.first("k").alias("k"), F.sum("n").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("sign"))
    one = bands.groupBy("k", "size", "sign").agg(F.min(F.struct("band", "key")).alias("b"))
    tiles = F.greatest(F.ceil(F.col("k") / TILE), F.ceil(F.col("size") / TILE_SHINGLES)).cast("int").alias("tiles")
    return written(rows.join(one.select(F.col("b.key").alias("key_"), tiles), F.col("key") == F.col("key_")).select("key", "band", "cls", "tiles"))


def tiled(mem: DataFrame) -> DataFrame:
    """(key, i, j, band, cls, tile): members of a band once per pair of tiles that they belong to."""
    rows = mem.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    pair = F.expr("transform(sequence(0, tiles - 1), o -> struct(least(tile, o) AS i, greatest(tile, o) AS j))")
    return rows.select("key", "band", "cls", "tile", F.explode(pair).alias("p")).select("key", "p.i", "p.j", "band", "cls", "tile")


def near_pairs(t: pd.DataFrame, threshold: float) -> np.ndarray:
    """(x, y, differing registers) of the members' pairs to be settled here, most alike first.

    Those from different tiles (if there are two) that share no earlier band, and whose sizes and
    estimated similarity allow a link.
    """
    regs = np.frombuffer(b"".join(t["regs"]), np.uint16).reshape(len(t), ss.M)
    n, tile = t["n"].to_numpy(), t["tile"].to_numpy()
    across, band = t["i"].iloc[0] != t["j"].iloc[0], t["band"].iloc[0]
    least, per_cent = threshold - MARGIN, round(threshold * 100)
    pairs = [np.zeros((0, 3), np.int64)]
    for x in range(len(t) - 1):
        y = np.arange(x + 1, len(t))
        if across:
            y = y[tile[y] != tile[x]]
        y = y[100 * np.minimum(n[x], n[y]) >= per_cent * np.maximum(n[x], n[y])]
        differ = (regs[x] != regs[y]).sum(1)
        y = y[differ <= ss.M * (1 - least + 0.1)]
        if len(y):
            first = (regs[x] == regs[y]).reshape(len(y), ss.BANDS, ss.ROWS).all(2).argmax(1)
            y = y[first == band]
        if len(y):
            less, more = (regs[x] < regs[y]).sum(1), (regs[x] > regs[y]).sum(1)
            near = ss.estimated(less, more, np.full(len(y), n[x]), n[y]) >= least
            pairs.append(np.column_stack([np.full(near.sum(), x), y[near], (less + more)[near]]))
    pairs = np.concatenate(pairs)
    return pairs[np.argsort(pairs[:, 2], kind="stable")]


def in_groups(rows: DataFrame, work, schema: str, to_batch, size: int) -> DataFrame:
    """``work`` on every (key, i, j) group of ``rows`` as a pandas table; its results, in lists, become batches by ``to_batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found = None, []
        for batch in batches:
            t = batch.to_pandas()
            t = t if rest is None else pd.concat([rest, t], ignore_index=True)
            cuts = np.flatnonzero((t[["key", "i", "j"]] != t[["key", "i", "j"]].shift()).any(axis=1).to_numpy())
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s > 1:
                    found += work(t.iloc[s:e])
            rest = t.iloc[cuts[-1] :] if len(cuts) else t
            if len(found) > 50_000:
                yield to_batch(found)
                found = []
        if rest is not None and len(rest) > 1:
            found += work(rest)
        if found:
            yield to_batch(found)

    return in_arrow(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, schema, size)


def needed(mem: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``tiled(mem)`` whose member has a pair to be settled there, so that other sets needn't be sent."""

    def work(t: pd.DataFrame) -> list[tuple]:
        some = np.unique(near_pairs(t, threshold)[:, :2])
        return list(t.iloc[some][["key", "i", "j", "band", "cls", "tile"]].itertuples(index=False, name=None))

    def to_batch(found: list) -> pa.RecordBatch:
        key, i, j, band, cls, tile = zip(*found)
        whole = [pa.array(key, pa.int64()), *(pa.array(c, pa.int32()) for c in (i, j, band))]
        return pa.RecordBatch.from_arrays([*whole, pa.array(cls, pa.int64()), pa.array(tile, pa.int32())], ["key", "i", "j", "band", "cls", "tile"])

    rows = tiled(mem).join(reps.select("cls", "n", "regs"), "cls")
    return written(in_groups(rows, work, "key bigint, i int, j int, band int, cls bigint, tile int", to_batch, 2000))


def full_sets(need: DataFrame, reps: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """(cls, n, regs, set): the sorted shingle hashes of every class with a pair to be settled."""
    wanted = written(need.select("cls").distinct().join(reps.select("cls", "id", "h", "n", "regs"), "cls"))
    keys = wanted.select("cls", F.col("id").alias("id_"), F.col("h").alias("h_"))
    keys = F.broadcast(keys) if wanted.count() <= LOOKUP else keys
    rows = inner_names(docs, {"id": id, "t": text}).withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    texts = rows.join(keys, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))).select("cls", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            first, h = ss.shingles(batch.column("t"))
            sets = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("cls"), sets], ["cls", "set"])

    sets = in_arrow(texts, run, "cls bigint, set binary").groupBy("cls").agg(F.first("set").alias("set"))
    return written(sets.join(wanted.select("cls", "n", "regs"), "cls"))


def links(need: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) pairs of classes, all confirmed on full sets, that connect what all links connect.

    A pair is settled in the first band that its sets share. Inside a band, pairs are confirmed in order
    of likeness, except those that links found before already connect. So a band yields fewer links
    than it has members, and all its pairs are settled. A task holds two tiles at a time.
    """
    per_cent = round(threshold * 100)

    def settle(t: pd.DataFrame) -> list[tuple[int, int]]:
        up = list(range(len(t)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        full = [np.frombuffer(x, np.uint64) for x in t["set"]]
        cls, found = t["cls"].to_numpy(), []
        for x, y, _ in near_pairs(t, threshold).tolist():
            p, q = root(x), root(y)
            if p != q:
                a, b = (full[x], full[y]) if len(full[x]) <= len(full[y]) else (full[y], full[x])
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * common >= per_cent * (len(a) + len(b) - common):
                    up[p] = q
                    found.append((cls[x], cls[y]))
        return found

    def to_batch(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return in_groups(need.join(sets, "cls"), settle, "a bigint, b bigint", to_batch, 200).distinct()


def grouped(docs: DataFrame, threshold: float, id: str, text: str) -> DataFrame:
    """What ``near_duplicates`` returns, with ``comp``, a name of the component that doesn't hang on ids (null without words)."""
    rows = written(sketched(docs, id, text))
    full = rows.where("n > 0")
    reps = full.groupBy("same").agg(F.min(F.struct("id", "h")).alias("r"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    # once written, a class goes by a number
    reps = written(reps.select(F.monotonically_increasing_id().alias("cls"), "same", "r.id", "r.h", "low", "n", "regs"))
    mem = members(reps)
    need = needed(mem, reps, threshold)
    found = links(need, full_sets(need, reps, docs, id, text), threshold)
    linked = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    comps = written(linked.select(F.col("wallet").alias("cls"), F.col("component").alias("comp")))

    joined = reps.select("cls", "same", "low").join(comps.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    final = written(joined.select("same", "comp").join(names, "comp").select(F.col("same").alias("same_"), "comp", "component_id"))
    got = rows.select("id", "h", "n", "same").join(final, (F.col("n") > 0) & (F.col("same") == F.col("same_")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    got = got.select("id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), "comp")
    return got.withColumn("kept", F.col("component_id").eqNullSafe(F.col("id")))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, n_shingles, component_id, kept) per row; h is a hash of the text.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity
    of ``threshold`` or more; a component is named after its smallest id. Equal sets are one class from
    the start, so copies of any number cost one row each. Classes meet in bands of equal
    registers, where every pair that may be linked is settled on full sets unless other links already
    connect it, so no link between components is lost that the bands show. Texts without words are
    linked with nothing, not even each other. A null id is in the component of its copies, or without any,
    null and kept. Rows that share id and text share the result. An empty table gives an empty result; very long texts are
    read whole; other columns play no part, whatever their names.
    """
    return grouped(docs, threshold, id, text).drop("comp")


def deduplicated(docs: DataFrame, *, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one document of each component, with its smallest id.

    Of rows that share this id the one whose text has the smallest hash stays, once if it is repeated; a component whose ids are all
    null keeps one row likewise. Texts without words are in no component and all stay. Any other columns pass through,
    whatever their names; an empty table stays empty; texts are read whole and aren't shuffled, but for rows that repeat both id and text.
    """
    got = written(grouped(docs, threshold, id, text))
    mine = F.col("kept") & F.col("comp").isNotNull()
    first = got.where(mine).groupBy("comp").agg(F.min("h").alias("h0"))
    fate = got.join(first.withColumnRenamed("comp", "comp_"), mine & (F.col("comp") == F.col("comp_")), "left")
    fate = written(fate.select("id", "h", (F.col("kept") & (F.col("comp").isNull() | (F.col("h") == F.col("h0")))).alias("stays"), F.col("comp").isNull().alias("bare")))
    gone = fate.where(~F.col("stays")).select(F.col("id").alias("gone_id_"), F.col("h").alias("gone_h_")).distinct()
    again = fate.where(F.col("stays") & ~F.col("bare")).groupBy("id", "h").count().where("count > 1")
    again = written(again.select(F.col("id").alias("gone_id_"), F.col("h").alias("gone_h_")))
    h = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))

    def same(side):
        return F.col(f"`{id}`").eqNullSafe(side["gone_id_"]) & (h == side["gone_h_"])

    gone = written(gone)
    left = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left
    names = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    key, told = (F.col(names[lower.index(c.lower())]) for c in (id, text))
    repeated = left.join(again, same(again), "left_semi").toDF(*names)
    once = repeated.groupBy(key.alias("id_"), F.xxhash64(told).alias("h_")).agg(F.first(F.struct(*names)).alias("r"))
    return left.join(again, same(again), "left_anti").unionByName(once.select("r.*").toDF(*docs.columns))
