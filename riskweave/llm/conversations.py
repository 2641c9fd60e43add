"""Conversations as a prefix trie: shards of sorted paths finish their own nodes, a broadcast skeleton of splitter paths the rest.

Node tables have one row per distinct sequence of first turns. Turns are stood for by 128-bit hashes, and a prefix by running
sums of such hashes of (position, turn), so that no conversation has to be gathered to name its prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from .common import in_arrow, inner_names, words_in, written

EMPTY = hashlib.sha256(b"").hexdigest()
TURNS = "conv long, pos long, turn string, words long"
SEGMENT = "conv_id long, n_convs long, top long, depth long, parent long, below long, n_children long, n_leaves long, ends_sha256 string"


def sequenced(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn, words): every turn's place in its conversation from 1 on, a hash of role and text, the words of the text.

    Order: turn (null first), then role by code point, then the MD5 of the text. Null role or text counts as empty;
    rows without conversation id belong to none. Texts aren't shuffled.
    """
    rows = inner_names(turns, {"conv": conv, "at": turn, "role": role, "t": text}).where("conv IS NOT NULL")
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "t"))
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "at", role_.alias("role"), F.md5(text_).alias("m"), words_in(text_).alias("words"))
    placed = ordered_scan(written(rows), ["conv"], ["at", "role", "m"], index="pos")
    return placed.select("conv", "pos", F.md5(F.concat(F.md5("role"), "m")).alias("turn"), "words")


def joined_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each begins with the first ``heads`` turns of another one instead of its own.

    ``base`` and ``heads`` are columns over ``conv``: the other conversation and how many turns (``most`` at most) of it
    are taken, all if it has fewer and none if it is absent. Own turns follow from behind the same number of own turns.
    """
    turns = written(turns)
    each = written(turns.select("conv").distinct().withColumns({"base": base, "h": heads}))
    first = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "turn", "words")
    taken = written(each.join(first, "base").where(F.col("pos") <= F.col("h")).select("conv", "pos", "turn", "words"))
    got = each.join(taken.groupBy("conv").agg(F.count(F.lit(1)).alias("got")), "conv", "left").select("conv", "h", F.coalesce("got", F.lit(0)).alias("got"))
    own = turns.join(got, "conv").where(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "turn", "words")
    return taken.unionByName(own), each.select("conv")


def _keyed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, a, b, total, words): one row per conversation and prefix, the empty one too; a and b name the prefix, total is its words."""
    low, parts = (1 << 32) - 1, {}
    for i, seed in enumerate((11, 12)):
        h = F.xxhash64(F.lit(seed), "pos", "turn")
        parts |= {f"p{2 * i}": F.shiftrightunsigned(h, 32), f"p{2 * i + 1}": h.bitwiseAND(F.lit(low))}
    # 32-bit parts keep running sums of up to 2 ** 31 turns within a long
    run = ordered_scan(written(turns.withColumns(parts)), ["conv"], ["pos"], running={**{f"s{i}": f"p{i}" for i in range(4)}, "total": "words"})
    sums = ["s0", "s1", "s2", "s3"]
    keys = run.select("conv", F.col("pos").alias("depth"), F.xxhash64(F.lit(1), "pos", *sums).alias("a"), F.xxhash64(F.lit(2), "pos", *sums).alias("b"), "total", "words")
    zero = F.lit(0).cast("long")
    return keys.unionByName(convs.select("conv", *[zero.alias(c) for c in ("depth", "a", "b", "total", "words")]))


def _paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, path, len, total): per conversation the forks on its way, with (conv_id, depth, total) each.

    Nodes with the same members make a run without forks; they are those with the same (conv_id, n_convs), since along any path
    the members only become fewer where a conversation ends or branches off. A fork is the deepest node of a run
    that several conversations share. A path with k forks takes k conversations that end at k different depths, so no path
    is longer than about the square root of twice the table.
    """
    shared = nodes.where("n_convs > 1").groupBy("conv_id", "n_convs").agg(F.max_by(F.struct("a", "b", "depth", "total"), "depth").alias("f"))
    forks = written(shared.select("f.a", "f.b", F.struct("conv_id", "f.depth", "f.total").alias("fork")))
    on = rows.select("conv", "a", "b").join(forks, ["a", "b"]).groupBy("conv").agg(F.collect_list("fork").alias("path"))
    last = rows.groupBy("conv").agg(F.max("depth").alias("len"))
    path = F.array_sort("path", lambda x, y: F.when(x["depth"] < y["depth"], -1).otherwise(1))
    return last.join(on.select("conv", path.alias("path")), "conv", "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<conv_id:bigint,depth:bigint,total:bigint>>")))


class Shard:
    """Walks conversations in path order and closes each node when the order leaves it.

    Nodes on splitter paths may go on in other shards: for these only this shard's share is given out (``partial``),
    and their endings as texts of ids (``piece``).
    """

    PIECE = 1 << 18

    def __init__(self, skeleton: set[tuple[int, ...]]):
        self.skeleton = skeleton
        self.open: list[dict] = []
        self.rows: list[tuple] = []

    def add(self, conv: int, path: list[dict], length: int) -> None:
        way = tuple(f["conv_id"] for f in path)
        same = 0
        while same < min(len(way), len(self.open)) and self.open[same]["way"][-1] == way[same]:
            same += 1
        self.leave(same)
        for i in range(same, len(way)):
            f = path[i]
            up = path[i - 1] if i else {"depth": -1, "total": 0, "conv_id": None}
            self.open.append({
                "way": way[: i + 1], "top": up["depth"] + 1, "depth": f["depth"], "words": f["total"] - up["total"], "parent": up["conv_id"],
                "n": 0, "below": 0, "children": 0, "leaves": 0, "sha": None, "first": None, "ids": [], "size": 0,
            })
        here = self.open[-1] if self.open else None
        if here is not None and here["depth"] == length:
            self.end(here, conv)
        else:  # goes on alone
            top, parent = (here["depth"] + 1, here["way"][-1]) if here else (0, None)
            self.rows.append(("done", (conv,), conv, 1, top, length, parent, 0, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest(), None))
            if here is not None:
                here["children"] += 1
                here["leaves"] += 1
        if here is not None:
            here["n"] += 1

    def end(self, node: dict, conv: int) -> None:
        """Ids arrive in ascending order."""
        text = str(conv)
        if node["way"] not in self.skeleton:
            if node["sha"] is None:
                node["sha"] = hashlib.sha256(text.encode())
            else:
                node["sha"].update(f",{text}".encode())
            return
        node["first"] = conv if node["first"] is None else node["first"]
        node["ids"].append(text)
        node["size"] += len(text) + 1
        if node["size"] > self.PIECE:
            self.piece(node)

    def piece(self, node: dict) -> None:
        if node["ids"]:
            self.rows.append(("piece", node["way"], node["first"], 0, 0, 0, None, 0, 0, 0, 0, None, ",".join(node["ids"])))
            node["first"], node["ids"], node["size"] = None, [], 0

    def leave(self, depth: int) -> None:
        """Closes the open nodes from ``depth`` on, each feeding the one above."""
        while len(self.open) > depth:
            n = self.open.pop()
            up = self.open[-1] if self.open else None
            cut = n["way"] in self.skeleton
            if up is not None:
                up["n"] += n["n"]
            if cut:
                self.piece(n)
                self.rows.append(("partial", n["way"], n["way"][-1], n["n"], n["top"], n["depth"], n["parent"], n["below"], n["children"], n["leaves"], n["words"], None, None))
            else:
                leaves = n["leaves"] if n["children"] else 1
                sha = n["sha"].hexdigest() if n["sha"] else EMPTY
                self.rows.append(("done", n["way"][-1:], n["way"][-1], n["n"], n["top"], n["depth"], n["parent"], n["below"], n["children"], leaves, 0, sha, None))
                if up is not None:
                    up["children"] += 1
                    up["leaves"] += leaves
                    up["below"] += n["below"] + (n["n"] - 1) * n["words"]

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


OUT = "kind string, way array<long>, conv_id long, n_convs long, top long, depth long, parent long, below long, n_children long, n_leaves long, words long, ends_sha256 string, ids string"


def _walked(sorted_paths: DataFrame, skeleton) -> DataFrame:
    names = [p.split()[0] for p in OUT.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}[p.split()[1]] for p in OUT.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = Shard(skeleton.value), None
        for b in batches:
            for at, conv, path, length in zip(*(b.column(c).to_pylist() for c in ("shard", "conv", "path", "len"))):
                if at != now:  # a task may hold several shards that don't follow one another
                    shard.leave(0)
                    now = at
                shard.add(conv, path, length)
                if len(shard.rows) > 2000:
                    yield batch(shard.taken())
        shard.leave(0)
        rows = shard.taken()
        if rows:
            yield batch(rows)

    return in_arrow(sorted_paths.select("shard", "conv", "path", "len"), run, OUT)


def _skeleton_rows(partial: DataFrame, digests: DataFrame) -> DataFrame:
    """Finished rows of the skeleton's nodes: shares summed over the shards, then handed from each node to those above it.

    There is one row per node, and a node is a beginning of one of the splitter paths, one for each shard; sums over their
    descendants are taken along the paths by aggregation.
    """
    same = ["top", "depth", "parent", "words"]
    sums = ["n_convs", "below", "n_children", "n_leaves"]
    node = written(partial.groupBy("way").agg(*[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in sums]))
    own = node.select("way", "below", "n_leaves", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    kids = node.where(F.size("way") > 1).groupBy(F.slice("way", 1, F.size("way") - 1).alias("way")).agg(F.count(F.lit(1)).alias("kids"))
    leaf = node.join(kids, "way", "left").select("way", ((F.col("n_children") == 0) & F.col("kids").isNull()).cast("long").alias("leaf"), F.coalesce("kids", F.lit(0)).alias("kids"))
    own = own.join(leaf, "way")
    up = own.select("way", F.explode(F.sequence(F.lit(1), F.size("way"))).alias("k"), "below", "n_leaves", "leaf", "saved")
    up = up.groupBy(F.slice("way", 1, F.col("k")).alias("way")).agg(
        F.sum("below").alias("below"), F.sum(F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        F.sum(F.when(F.col("k") < F.size("way"), F.col("saved")).otherwise(0)).alias("beneath"),
    )
    whole = node.select("way", "n_convs", "top", "depth", "parent", "n_children").join(up, "way").join(leaf.select("way", "kids"), "way")
    return whole.join(digests, "way", "left").select(
        F.element_at("way", -1).alias("conv_id"), "n_convs", "top", "depth", "parent", (F.col("below") + F.col("beneath")).alias("below"),
        (F.col("n_children") + F.col("kids")).alias("n_children"), "n_leaves", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _digests(pieces: DataFrame) -> DataFrame:
    """(way, sha) of the ids in pieces that shards have joined and sorted: read in order, never held together."""
    rows = pieces.select("way", F.col("conv_id").alias("first"), "ids").repartition("way").sortWithinPartitions("way", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.list_(pa.int64())), pa.array([sha.hexdigest()])], names=["way", "sha"])

        for b in batches:
            for way, ids in zip(b.column("way").to_pylist(), b.column("ids").to_pylist()):
                if way == now:
                    sha.update(f",{ids}".encode())
                    continue
                if now is not None:
                    yield told()
                now, sha = way, hashlib.sha256(ids.encode())
        if now is not None:
            yield told()

    return in_arrow(rows, run, "way array<long>, sha string", 16)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, pos, turn, words), members being the ids of ``convs`` (conv).

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; root: null), n_convs, n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (summed over its subtree, (n_convs - 1) times the words of a node's
    last turn), ends_sha256 (of the ids that end there).

    Prefixes are counted by aggregation with partial sums in the tasks, so a first turn that most conversations share costs each
    task one row. Conversations, reduced to the forks on their paths, are range-partitioned by path and id, so copies of
    one conversation may span shards. The paths at which shards begin make the skeleton, one path per shard; it is
    broadcast, and every node off it lies in one shard, which finishes it. Shares of skeleton nodes are summed. The ids that
    end at one node are digested in one go, as the digest demands, from pieces of 256 KB.

    ``pos`` is unique in a conversation and counts from 1. A conversation without turns ends at the root; an empty ``convs`` has no
    nodes; a conversation with most of the turns is scanned in pieces (see ``ordered_scan``).
    """
    rows = written(_keyed(turns, convs))
    nodes = written(rows.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("total").alias("total"), F.first("words").alias("words")))

    # Shards: the order of paths as lists of conv_ids, then of ids. A path sorts before those that go on from it.
    order = ["way", "conv"]
    paths = _paths(rows, nodes).withColumn("way", F.transform("path", lambda f: f["conv_id"]))
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(paths.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id()))
    starts = cut.groupBy("shard").agg(F.min(F.struct(*order)).alias("s")).orderBy("shard").select(F.col("s.way").alias("way")).collect()
    skeleton = {tuple(s.way[: i + 1]) for s in starts[1:] for i in range(len(s.way))}
    again = cut.repartition(parts, "shard").sortWithinPartitions("shard", *order)
    out = written(_walked(again, spark.sparkContext.broadcast(skeleton)))

    done = out.where("kind = 'done'").select("conv_id", "n_convs", "top", "depth", "parent", "below", "n_children", "n_leaves", "ends_sha256")
    split = _skeleton_rows(out.where("kind = 'partial'"), _digests(out.where("kind = 'piece'")))
    s = done.unionByName(split).select("conv_id", "n_convs", "top", F.col("depth").alias("bottom"), "parent", "below", "n_children", "n_leaves", "ends_sha256")

    # Every node from the run it belongs to. Words from a node to the end of its run: by the fork's total, or irrelevant if alone.
    ends = nodes.groupBy("conv_id", "n_convs").agg(F.max("total").alias("end_total"))
    n = nodes.join(s.join(ends, ["conv_id", "n_convs"]), ["conv_id", "n_convs"])
    at_end = F.col("depth") == F.col("bottom")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("end_total") - F.col("total") + F.col("words"))
    return n.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.when(at_end, F.col("ends_sha256")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
