"""Triangles, clustering coefficient, ego cycles and bounded cycles."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .grouped import MOST_LINKS, by_group


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """One row per linked pair ``a < b`` with the directions that exist."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.col("src") < F.col("dst")).alias("ab"), F.max(F.col("src") > F.col("dst")).alias("ba")
    )


def _degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))


def triangles(edges: DataFrame) -> DataFrame:
    """Each undirected triangle once, with the directions of its three sides.

    Links point from the lower to the higher (degree, id). A node then has at most
    about sqrt(2 x links) outgoing links, so hubs cause no quadratic wedge count.
    """
    pairs = undirected_pairs(edges)
    d = _degrees(pairs)
    p = pairs.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    o = p.select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"),
        F.when(up, F.col("ab")).otherwise(F.col("ba")).alias("fwd"),
        F.when(up, F.col("ba")).otherwise(F.col("ab")).alias("bwd"),
    )
    one = o.select(F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("fwd").alias("xy"), F.col("bwd").alias("yx"))
    two = o.select(F.col("lo").alias("x"), F.col("hi").alias("z"), F.col("fwd").alias("xz"), F.col("bwd").alias("zx"))
    wedge = one.join(two, "x").where(F.col("y") < F.col("z"))
    side = pairs.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("ab").alias("yz"), F.col("ba").alias("zy"))
    return wedge.join(side, ["y", "z"]).select("x", "y", "z", "xy", "yx", "xz", "zx", "yz", "zy")


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA3: local clustering coefficient on the undirected graph."""
    t = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("wallet")).groupBy("wallet").agg(F.count(F.lit(1)).alias("t"))
    d = _degrees(undirected_pairs(edges)).toDF("wallet", "d")
    out = nodes.select("wallet").join(d, "wallet", "left").join(t, "wallet", "left")
    value = 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))
    return out.select("wallet", F.when(F.col("d") > 1, value).otherwise(0.0).alias("clustering_coefficient"))


def ego_links(edges: DataFrame) -> DataFrame:
    """Links ``a -> b`` between two neighbours of ``w``; ``starts``: w -> a exists, ``ends``: b -> w exists."""

    def view(w, p, q):
        def row(a, b):
            return F.struct(
                F.col(w).alias("w"), F.col(a).alias("a"), F.col(b).alias("b"),
                F.col(w + a).alias("starts"), F.col(b + w).alias("ends"), F.col(a + b).alias("exists"),
            )

        return [row(p, q), row(q, p)]

    rows = view("x", "y", "z") + view("y", "x", "z") + view("z", "x", "y")
    return triangles(edges).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("exists").drop("exists")


class _Ego:
    """Walks inside all ego networks at once: vectors have a value per (w, wallet), links lead from ``a`` to ``b`` of the same ``w``."""

    def __init__(self, links: DataFrame):
        self.links = links.select("w", "a", "b")
        back = self.links.select("w", F.col("b").alias("a"), F.col("a").alias("b"))
        #: links that exist both ways
        self.mutual = cut_lineage(self.links.join(back, ["w", "a", "b"], "left_semi"))
        into = links.where("starts").select("w", F.col("a").alias("x"), F.lit(1).alias("p0"), F.lit(0).alias("q0"))
        out = links.where("ends").select("w", F.col("b").alias("x"), F.lit(0).alias("p0"), F.lit(1).alias("q0"))
        ends = into.unionByName(out).groupBy("w", "x").agg(F.max("p0").cast("long").alias("p0"), F.max("q0").cast("long").alias("q0"))
        rest = self.mutual.groupBy("w", F.col("a").alias("x")).agg(F.count(F.lit(1)).alias("m"))
        self.at = cut_lineage(_summed([ends, rest], ["w", "x"], ["p0", "q0", "m"]))

    def through(self, value: str, forward: bool, out: str, links: DataFrame | None = None) -> DataFrame:
        """``value`` carried one link on (or back), summed per (w, x)."""
        here, there = ("a", "b") if forward else ("b", "a")
        v = self.at.where(F.col(value) != 0).select("w", F.col("x").alias(here), value)
        return v.join(self.links if links is None else links, ["w", here]).groupBy("w", F.col(there).alias("x")).agg(F.sum(value).alias(out))

    def add(self, tables: list[DataFrame], columns: list[str]) -> None:
        """Further values per (w, x)."""
        have = [c for c in self.at.columns if c not in ("w", "x")]
        self.at = cut_lineage(_summed([self.at, *tables], ["w", "x"], have + columns))


def _summed(tables: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """The tables' columns side by side, 0 where a table lacks a key: a union and one aggregation in place of outer joins."""
    zero = F.lit(0).cast("long")
    rows = [t.select(*keys, *[F.col(c) if c in t.columns else zero.alias(c) for c in columns]) for t in tables]
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def ego_cycles(edges: DataFrame) -> DataFrame:
    """GRA5a: cycles of up to 3, 4, 5 and 6 wallets through ``wallet`` inside its ego network, all counted and none enumerated.

    A cycle of k wallets is a walk over k - 1 distinct neighbours. Walks are counted by carrying numbers along links; walks that meet a
    neighbour again are taken off by inclusion and exclusion over which places coincide. That takes, besides
    the walks themselves, returns over two, three and four links, found from wedges counted per pair of linked or mutual neighbours.
    """
    two = undirected_pairs(edges).where("ab AND ba").select(F.explode(F.array("a", "b")).alias("w"))
    two = two.groupBy("w").agg(F.count(F.lit(1)).alias("c2"))
    links = cut_lineage(ego_links(edges))
    three = links.where("starts AND ends").groupBy("w").agg(F.count(F.lit(1)).alias("c3"))
    ego = _Ego(links)

    # p_i: walks of i links from a wallet's targets to x; q_i: from x to its sources; m: mutual links of x
    ego.add([ego.through("p0", True, "p1"), ego.through("q0", False, "q1"), ego.through("m", True, "mm", ego.mutual)], ["p1", "q1", "mm"])
    ego.add([ego.through("p1", True, "p2"), ego.through("q1", False, "q2")], ["p2", "q2"])

    # wedges x -> y -> z, where z is linked back to x (three links closed) or mutually linked with x
    one, two_ = links.select("w", F.col("a").alias("x"), F.col("b").alias("y")), links.select("w", F.col("a").alias("y"), F.col("b").alias("z"))
    closing = links.select("w", F.col("b").alias("x"), F.col("a").alias("z"))
    wedge = one.join(two_, ["w", "y"]).where(F.col("x") != F.col("z"))
    closed = cut_lineage(wedge.join(closing, ["w", "x", "z"]).groupBy("w", "x", "z").agg(F.count(F.lit(1)).alias("n")))
    turn = closed.groupBy("w", "x").agg(F.sum("n").alias("t"))
    # returns over four links to wallets with both ends: wedges from them, joined with wedges to them
    both = ego.at.where("p0 > 0 AND q0 > 0").select("w", "x")
    out = one.join(both, ["w", "x"], "left_semi").join(two_, ["w", "y"]).groupBy("w", "x", "z").agg(F.count(F.lit(1)).alias("n1"))
    home = two_.join(both.withColumnRenamed("x", "z"), ["w", "z"], "left_semi").join(one, ["w", "y"])
    home = home.groupBy("w", F.col("z").alias("x"), F.col("x").alias("z")).agg(F.count(F.lit(1)).alias("n2"))
    four = out.join(home, ["w", "x", "z"]).groupBy("w", "x").agg(F.sum(F.col("n1") * F.col("n2")).alias("r4"))
    ego.add([turn, four], ["t", "r4"])

    v = F.col
    flat = ego.at.groupBy("w").agg(
        F.sum(v("p1") * v("q1") - v("p0") * v("q0") * v("m")).alias("c4"),
        F.sum(v("p1") * v("q2") - v("m") * (v("p0") * v("q1") + v("p1") * v("q0")) - v("p0") * v("q0") * v("t")).alias("c5"),
        F.sum(
            v("p2") * v("q2") - v("m") * (v("p0") * v("q2") + v("p1") * v("q1") + v("p2") * v("q0")) - v("t") * (v("p0") * v("q1") + v("p1") * v("q0"))
            + v("p0") * v("q0") * (2 * v("m") * (v("m") - 1) + v("mm") - v("r4"))
        ).alias("c6"),
    )
    here = ego.at.select("w", F.col("x").alias("a"), F.col("p0").alias("pa"), F.col("p1").alias("pa1"))
    there = ego.at.select("w", F.col("x").alias("b"), F.col("q0").alias("qb"), F.col("q1").alias("qb1"))
    # walks that go to and fro between the same two
    fro = ego.mutual.join(here, ["w", "a"]).join(there, ["w", "b"]).groupBy("w").agg(
        F.sum(v("pa") * v("qb")).alias("c5"), F.sum(v("pa") * v("qb1") + v("pa1") * v("qb")).alias("c6"))
    # walks that use a link twice with a wedge home between; and those with a wedge beside a mutual pair, in two orders
    again = closed.select("w", F.col("z").alias("a"), F.col("x").alias("b"), "n")
    beside = closed.select("w", F.col("x").alias("a"), F.col("z").alias("b"), (2 * v("n")).alias("n")).join(ego.mutual, ["w", "a", "b"])
    wedged = again.unionByName(beside).join(here, ["w", "a"]).join(there, ["w", "b"]).groupBy("w").agg(F.sum(v("pa") * v("qb") * v("n")).alias("c6"))

    walls = edges.select(F.explode(F.array("src", "dst")).alias("w")).distinct()
    n = _summed([walls, two, three, flat, fro, wedged], ["w"], ["c2", "c3", "c4", "c5", "c6"])
    n3 = v("c2") + v("c3")
    n4 = n3 + v("c4")
    n5 = n4 + v("c5")
    return n.select(v("w").alias("wallet"), n3.alias("n3"), n4.alias("n4"), n5.alias("n5"), (n5 + v("c6")).alias("n6"))


def trim(edges: DataFrame, rounds: int) -> DataFrame:
    """Drop links that cannot lie on a cycle: their source is never reached or their target has no way on."""
    e = cut_lineage(edges.select("src", "dst"))
    size = e.count()
    for _ in range(rounds):
        s, d = e.select(F.col("src").alias("dst")).distinct(), e.select(F.col("dst").alias("src")).distinct()
        e = cut_lineage(e.join(s, "dst", "left_semi").join(d, "src", "left_semi").select("src", "dst"))
        left = e.count()
        if left == size:
            break
        size = left
    return e


def _least_before(e: DataFrame) -> DataFrame:
    """(v, l): the smallest wallet from which each wallet can be reached, itself included; settled by rounds of one join each."""
    nodes = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct()
    label = cut_lineage(nodes.select("v", F.col("v").alias("l")))
    while True:
        seen = e.join(label, e.src == label.v).select(F.col("dst").alias("v"), "l")
        new = label.select("v", "l", F.col("l").alias("old")).unionByName(seen.withColumn("old", F.lit(None).cast("string")))
        new = cut_lineage(new.groupBy("v").agg(F.min("l").alias("l"), F.max("old").alias("old")))
        changed = not new.where(F.col("l") != F.col("old")).isEmpty()
        label = new.select("v", "l")
        if not changed:
            return label


def _same_label(e: DataFrame, label: DataFrame) -> DataFrame:
    s, d = label.select(F.col("v").alias("src"), F.col("l").alias("ls")), label.select(F.col("v").alias("dst"), F.col("l").alias("ld"))
    return cut_lineage(e.join(s, "src").join(d, "dst").where(F.col("ls") == F.col("ld")).select("src", "dst"))


def _links_on_cycles(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Links whose ends reach each other: an order of leaving by depth, then floods against the links in its reverse."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
        back[b].append(a)
    left, seen, part = [], set(), {}
    for start in out:
        stack = [] if start in seen else [(start, iter(out[start]))]
        seen.add(start)
        while stack:
            u, ways = stack[-1]
            v = next((x for x in ways if x not in seen), None)
            if v is None:
                left.append(u)
                stack.pop()
            else:
                seen.add(v)
                stack.append((v, iter(out.get(v, ()))))
    for root in reversed(left):
        stack = [] if root in part else [root]
        while stack:
            u = stack.pop()
            if u not in part:
                part[u] = root
                stack += back.get(u, ())
    return [(a, b) for a, b in pairs if part[a] == part[b]]


def _settled(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Links with their component ``g``, of components of up to ``most`` links, which fit a task; and the other links."""
    e = cut_lineage(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    comp = connected_components(e).select(F.col("wallet").alias("src"), F.col("component").alias("g"))
    placed = cut_lineage(e.join(comp, "src"))
    big = cut_lineage(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("g"))
    return placed.join(big, "g", "left_anti").select("g", "src", "dst"), placed.join(big, "g", "left_semi").select("src", "dst")


def strong_links(edges: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """Links inside strongly connected parts, which are those that lie on some cycle.

    Components of up to ``most`` links are settled inside tasks. In larger ones, ends of a link on a cycle are
    reached from the same smallest wallet and reach the same smallest wallet; links whose ends differ in either go,
    until none does.
    """
    small, large = _settled(edges, most)
    if not large.isEmpty():
        again, large = _settled(trim(large, 10), most)
        small = small.unionByName(again)
    small = by_group(small, "src string, dst string", ["src", "dst"], _links_on_cycles)
    e = cut_lineage(large)
    size = e.count()
    while size:
        e = _same_label(e, _least_before(e))
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        e = _same_label(e, _least_before(back))
        left = e.count()
        if left == size:
            break
        size = left
    return cut_lineage(small.unionByName(e))


#: Links from which a component's cycles are not walked in one task.
MOST_WALKED = 2_000


def _cycles_within(pairs: list[tuple[str, str]], max_length: int):
    """(path,) of each simple cycle of up to ``max_length`` wallets; a walk from the smallest wallet goes on only while it can still get home."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in _links_on_cycles(pairs):
        out[a].append(b)
        back[b].append(a)
    for root in sorted(out):
        home, near = {root: 0}, [root]
        for far in range(1, max_length):
            near = [v for u in near for v in back[u] if v > root and v not in home and home.setdefault(v, far)]
        path, on, stack = [root], {root}, [iter(out[root])]
        while stack:
            v = next(stack[-1], None)
            if v is None:
                stack.pop()
                on.discard(path.pop())
            elif v == root:
                yield (list(path),)
            elif v not in on and v in home and len(path) + home[v] <= max_length:
                path.append(v)
                on.add(v)
                stack.append(iter(out[v]))


def simple_cycles(edges: DataFrame, max_length: int = 10, most: int = MOST_WALKED) -> DataFrame:
    """GRA5: each simple cycle of up to ``max_length`` wallets once, as a path from its smallest wallet.

    Components of up to ``most`` links are walked inside tasks. In larger ones a cycle is two paths between its smallest wallet and
    the wallet halfway round. Only such halves are walked, inside strongly connected
    parts, and they meet by a join on both ends; so no path longer than half a cycle is kept.
    """
    if max_length < 2:
        raise ValueError("a cycle has at least two wallets")
    small, large = _settled(edges, most)
    rest = not large.isEmpty()
    if rest:
        again, large = _settled(strong_links(large), most)
        small = small.unionByName(again)
    walked = by_group(small, "path array<string>", ["path"], lambda pairs: _cycles_within(pairs, max_length))
    walked = cut_lineage(walked.select("path", F.size("path").alias("length")))
    e = cut_lineage(large)
    if not rest or e.isEmpty():
        return walked
    out = e.where(F.col("dst") > F.col("src")).select(F.col("src").alias("root"), F.array("dst").alias("path"), F.col("dst").alias("last"))
    home = e.where(F.col("src") > F.col("dst")).select(F.col("dst").alias("root"), F.array("src").alias("path"), F.col("src").alias("last"))
    on, back = e.toDF("last", "next"), e.toDF("next", "last")
    found: list[DataFrame] = [walked]
    for length in range(2, max_length + 1):
        # halves of the same number of links, or one more on the way out
        if length > 2:
            if length % 2:
                out = _longer(out, on)
            else:
                home = _longer(home, back)
        meet = out.join(home.withColumnRenamed("path", "rest"), ["root", "last"])
        ways = F.concat(F.array("root"), F.col("path"), F.slice(F.reverse("rest"), 2, max_length))
        found.append(meet.where(F.size(F.array_intersect("path", "rest")) == 1).select(ways.alias("path"), F.lit(length).alias("length")))
        if out.isEmpty() or home.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _longer(paths: DataFrame, step: DataFrame) -> DataFrame:
    """Paths from ``root`` over larger wallets, one link longer."""
    grown = paths.join(step, "last").where((F.col("next") > F.col("root")) & ~F.array_contains("path", F.col("next")))
    return cut_lineage(grown.select("root", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last")))


def cycles_per_wallet(cycles: DataFrame) -> DataFrame:
    """GRA5b: number of cycles each wallet lies on."""
    return cycles.select(F.explode("path").alias("wallet")).groupBy("wallet").agg(F.count(F.lit(1)).alias("circularity_score"))


def groups_with_cycle(edges: DataFrame, max_length: int = 8) -> DataFrame:
    """Groups of ``edges(grp, src, dst)`` holding a cycle of at most ``max_length`` wallets.

    A closed walk always contains a cycle no longer than itself, so reachable pairs
    suffice: no paths are enumerated, and a group leaves the search once it is decided.
    """
    e = cut_lineage(edges.select("grp", "src", "dst").distinct())
    for _ in range(max_length):
        s = e.select("grp", F.col("src").alias("dst")).distinct()
        d = e.select("grp", F.col("dst").alias("src")).distinct()
        smaller = cut_lineage(e.join(s, ["grp", "dst"], "left_semi").join(d, ["grp", "src"], "left_semi").select("grp", "src", "dst"))
        if smaller.count() == e.count():
            break
        e = smaller
    reach = e.select("grp", F.col("src").alias("s"), F.col("dst").alias("v"))
    found = None
    for k in range(2, max_length + 1):
        if reach.isEmpty():
            break
        grown = reach.join(e.select("grp", F.col("src").alias("v"), F.col("dst").alias("n")), ["grp", "v"])
        grown = cut_lineage(grown.select("grp", "s", F.col("n").alias("v")).distinct())
        hit = grown.where(F.col("s") == F.col("v")).select("grp").distinct()
        found = hit if found is None else found.union(hit)
        reach = cut_lineage(grown.join(hit, "grp", "left_anti"))
        e = e.join(hit, "grp", "left_anti")
    return found.distinct() if found is not None else e.select("grp").limit(0)
