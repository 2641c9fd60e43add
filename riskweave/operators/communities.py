"""Communities by modularity (Louvain, Leiden): whole components inside tasks, giant ones by moves over tasks.

Components don't compete for anything but the total weight, so a component of bounded size is settled in one go in
the task that reads it. In larger ones many nodes that gain move at once, from communities of lower to those of higher rank, as long as the
totals they change together leave them a gain; few nodes that gain are settled in one task against the totals of all communities.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .grouped import MOST_LINKS, by_group
from .ordered import ordered_scan

EPS = 1e-9


def undirected(edges: DataFrame) -> DataFrame:
    """Unweighted undirected edges, both directions, weight 1."""
    one = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    one = one.distinct()
    return one.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w")).unionByName(
        one.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1.0).alias("w"))
    )


def modularity(sym: DataFrame, part: DataFrame) -> float:
    """Modularity of ``part(u, c)`` on symmetric edges ``sym(u, v, w)`` (self links appear once with doubled weight)."""
    cv = part.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    e = sym.join(part, "u").join(cv, "v")
    total = sym.agg(F.sum("w")).first()[0] or 0.0
    if total == 0:
        return 0.0
    by = e.groupBy("c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("c") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("i"))
    return by.agg(F.sum(F.col("i") / total - F.pow(F.col("k") / total, 2))).first()[0]


def degrees(sym: DataFrame) -> DataFrame:
    """(u, k, n): weight and number of each node's links."""
    return sym.groupBy("u").agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("n"))


def wishes(sym: DataFrame, part: DataFrame, total: float, degree: DataFrame | None = None, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(u, k, n, c0, g0, c1, more): every node's worth where it is, the best neighbouring community, if any, and what moving there adds.

    With ``may(c0, c)``, also (c2, more2): the best of the communities ``c`` to which it holds. Links are shuffled once, to their node.
    """
    own = part.join(degrees(sym) if degree is None else degree, "u", "left").select("u", F.col("c").alias("c0"), F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("n", F.lit(0)).alias("n"))
    tot = own.groupBy(F.col("c0").alias("c")).agg(F.sum("k").alias("tot"))
    near = part.select(F.col("u").alias("v"), "c")
    pull = sym.where(F.col("u") != F.col("v")).join(near, "v").select("u", "c", "w").unionByName(own.select("u", F.col("c0").alias("c"), F.lit(0.0).alias("w")))
    options = pull.repartition("u").groupBy("u", "c").agg(F.sum("w").alias("w")).join(own, "u").join(tot, "c")
    stays, other = F.col("c") == F.col("c0"), F.struct((F.col("k") * F.col("tot") / total - F.col("w")).alias("g"), "c")
    best = options.groupBy("u").agg(
        F.first("c0").alias("c0"), F.first("k").alias("k"), F.first("n").alias("n"), F.max(F.when(stays, F.col("w"))).alias("w0"), F.max(F.when(stays, F.col("tot"))).alias("t0"),
        F.min(F.when(~stays, other)).alias("b1"), *([] if may is None else [F.min(F.when(~stays & may(F.col("c0"), F.col("c")), other)).alias("b2")]),
    ).withColumn("g0", F.col("w0") - F.col("k") * (F.col("t0") - F.col("k")) / total)
    found = [x for i in ((1,) if may is None else (1, 2)) for x in (F.col(f"b{i}.c").alias(f"c{i}"), (-F.col(f"b{i}.g") - F.col("g0")).alias("more" if i == 1 else "more2"))]
    return best.select("u", "k", "n", "c0", "g0", *found)


def gaining(sym: DataFrame, part: DataFrame, total: float, degree: DataFrame | None = None) -> DataFrame:
    """(u, k, c0, c1, gain): nodes that gain by moving to a neighbouring community, with the best one."""
    return wishes(sym, part, total, degree).where(F.col("more") > EPS).select("u", "k", "c0", "c1", F.col("more").alias("gain"))


# ---- inside a task -------------------------------------------------------------------------------------------

Links = dict[str, dict[str, float]]


def settle(links: Links, k: dict, part: dict, tot: dict, total: float, fixed: Links | None = None) -> bool:
    """Moves nodes between neighbouring communities until none gains; says whether any moved.

    ``fixed`` holds a node's pull to communities by nodes that don't move. A node whose neighbour moved is looked at again.
    """
    waiting, inside, moved = deque(sorted(links)), set(links), False
    while waiting:
        u = waiting.popleft()
        inside.discard(u)
        pull: dict[str, float] = defaultdict(float, fixed.get(u, {}) if fixed else {})
        for v, w in links[u].items():
            pull[part[v]] += w
        old = part[u]
        tot[old] -= k[u]
        best, most = old, pull.get(old, 0.0) - k[u] * tot[old] / total
        for c in sorted(pull):
            gain = pull[c] - k[u] * tot[c] / total
            if gain > most + EPS:
                best, most = c, gain
        tot[best] += k[u]
        if best != old:
            part[u], moved = best, True
            for v in links[u]:
                if part[v] != best and v not in inside:
                    inside.add(v)
                    waiting.append(v)
    return moved


def _totals(k: dict, part: dict) -> dict:
    tot: dict = defaultdict(float)
    for u, c in part.items():
        tot[c] += k[u]
    return tot


def refined(links: Links, k: dict, part: dict, total: float) -> dict:
    """Leiden's refinement: nodes alone join well connected parts inside their community, if modularity gains."""
    sub, size = {u: u for u in links}, dict(k)
    community = _totals(k, part)
    inner = {u: {v: w for v, w in links[u].items() if part[v] == part[u]} for u in links}
    reach = {u: sum(inner[u].values()) for u in links}  # weight from a part to the rest of its community
    alone = set(links)
    for u in sorted(links, key=lambda x: (-k[x], x)):
        whole = community[part[u]]
        if u not in alone or reach[u] < k[u] * (whole - k[u]) / total:
            continue
        pull: dict = defaultdict(float)
        for v, w in inner[u].items():
            pull[sub[v]] += w
        fits = [(pull[s] - k[u] * size[s] / total, s) for s in sorted(pull) if reach[s] >= size[s] * (whole - size[s]) / total]
        gain, s = max(fits, key=lambda x: x[0], default=(0.0, u))
        if gain > EPS:
            sub[u] = s
            alone -= {u, s}
            size[s] += k[u]
            reach[s] += reach[u] - 2 * pull[s]
    return sub


def split(links: Links, part: dict) -> dict:
    """Each community's connected pieces, each named after its smallest node."""
    name: dict = {}
    for start in sorted(links):
        if start not in name:
            name[start], stack = start, [start]
            while stack:
                for v in links[stack.pop()]:
                    if v not in name and part[v] == part[start]:
                        name[v] = start
                        stack.append(v)
    return name


def solve(links: Links, total: float, refine: bool) -> dict:
    """Communities of one component: local moves, contraction of the parts, until nothing joins; then nodes again, until none gains."""
    k = {u: sum(near.values()) for u, near in links.items()}
    flat = {u: u for u in links}
    here, weight, part = links, dict(k), {u: u for u in links}
    while True:
        settle(here, weight, part, _totals(weight, part), total)
        sub = refined(here, weight, part, total) if refine else part
        if len(set(sub.values())) == len(here):
            break
        up: Links = defaultdict(lambda: defaultdict(float))
        mass: dict = defaultdict(float)
        for u, near in here.items():
            mass[sub[u]] += weight[u]
            up[sub[u]]  # noqa: B018 - a part without links to others stays a node
            for v, w in near.items():
                if sub[v] != sub[u]:
                    up[sub[u]][sub[v]] += w
        part = {sub[u]: part[u] for u in here} if refine else {s: s for s in mass}
        flat = {u: sub[s] for u, s in flat.items()}
        here, weight = dict(up), dict(mass)
    out = split(links, {u: part[s] for u, s in flat.items()})
    while settle(links, k, out, _totals(k, out), total):
        out = split(links, out)
    return out


# ---- over tasks ----------------------------------------------------------------------------------------------


def _components_settled(sym: DataFrame, comp: DataFrame, total: float, refine: bool) -> DataFrame:
    """(u, c) for all nodes of ``sym`` whose components are given by ``comp(u, g)``."""

    def run(rows):
        links: Links = defaultdict(dict)
        for u, v, w in rows:
            links[u][v] = w
        yield from solve(dict(links), total, refine).items()

    return by_group(sym.join(comp, "u").select("g", "u", "v", "w"), "u string, c string", ["u", "c"], run)


def _moved(sym: DataFrame, part: DataFrame, movable: DataFrame, total: float) -> DataFrame:
    """``part`` after ``movable(u, k, n, c0)`` moved in one task until none of them gains; all other nodes stay, so that totals are exact."""
    volume = part.join(degrees(sym), "u").groupBy("c").agg(F.sum("k").alias("x"))
    near = part.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    link = sym.where(F.col("u") != F.col("v")).join(movable.select("u"), "u").join(near, "v")
    link = cut_lineage(link.join(movable.select(F.col("u").alias("v"), F.lit(True).alias("mine")), "v", "left"))
    pull = link.where("mine IS NULL").groupBy("u", F.col("cv").alias("c")).agg(F.sum("w").alias("x"))
    met = movable.select(F.col("c0").alias("c")).unionByName(link.select(F.col("cv").alias("c"))).distinct()
    kind = part.schema["u"].dataType
    none, text = F.lit(None).cast("string"), lambda c, name=None: F.col(c).cast("string").alias(name or c)
    rows = (
        volume.join(met, "c").select(none.alias("u"), text("c"), none.alias("v"), "x")
        .unionByName(movable.select(text("u"), text("c0", "c"), none.alias("v"), F.col("k").alias("x")))
        .unionByName(link.where("mine").select(text("u"), none.alias("c"), text("v"), F.col("w").alias("x")))
        .unionByName(pull.select(text("u"), text("c"), F.lit("").alias("v"), "x"))
    )

    def run(rows):
        tot: dict = defaultdict(float)
        k, at, links, fixed = {}, {}, defaultdict(dict), defaultdict(dict)
        for u, c, v, x in rows:
            if u is None:
                tot[c] = x
            elif v is None:
                k[u], at[u] = x, c
                links[u]  # noqa: B018 - a node may have no movable neighbour
            elif c is None:
                links[u][v] = x
            else:
                fixed[u][c] = x
        settle(dict(links), k, at, tot, total, fixed)
        yield from at.items()

    new = by_group(rows.withColumn("g", F.lit("")), "u string, c1 string", ["u", "c1"], run).select(F.col("u").cast(kind).alias("u"), F.col("c1").cast(kind).alias("c1"))
    return part.join(new, "u", "left").select("u", F.coalesce("c1", "c").alias("c"))


#: A node that gains belongs to this grade; others to a lower one, the more they would lose by moving.
GAINS = 1000
#: Passes in which ranks are two alone, after one that didn't raise modularity.
CAREFUL = 3


def _stepped(now: DataFrame, total: float, most_rows: int) -> DataFrame:
    """(u, c) after the moves to ``c2``, up to ``most_rows``, that keep a gain when all that gain more have changed the totals of both communities before."""
    goes = F.col("more2") > EPS
    some = now.where(goes).select("u", "k", "c0", "c2", "more2", (-F.col("more2")).alias("less"))
    some = ordered_scan(some, ["c2"], ["less", "u"], running={"into": "k"}, most_rows=most_rows)
    some = ordered_scan(some, ["c0"], ["less", "u"], running={"off": "k"}, most_rows=most_rows)
    left = F.col("more2") - F.col("k") * (F.col("into") + F.col("off") - 2 * F.col("k")) / total
    moved = some.select("u", F.when(left > EPS, F.col("c2")).otherwise(F.col("c0")).alias("c"))
    return moved.unionByName(now.where(~F.coalesce(goes, F.lit(False))).select("u", F.col("c0").alias("c")))


def local_moves(sym: DataFrame, part: DataFrame, total: float, most: int = MOST_LINKS, passes: int = 400) -> DataFrame:
    """``part(u, c)`` after passes of moves until no node gains by one; more than ``passes`` raise.

    While the nodes that gain have more than ``most`` links, communities are ranked anew in every pass and nodes move to higher ranks, so that no two
    change places; a pass after which modularity isn't higher is taken back. In the next ones ranks are two alone: nobody leaves a community that
    others join, so links can but help, and modularity rises. Otherwise nodes with up to ``most`` links in all, the ones that gain first and then
    those that lose least, are settled in one task. So modularity rises in every pass that is kept.
    """
    degree = cut_lineage(degrees(sym))
    grade = F.when(F.col("more") > EPS, GAINS).otherwise(F.floor(-2 * F.log2(F.greatest(-F.col("more"), F.lit(EPS))))).cast("int")
    kept, worth, tried, careful = None, 0.0, False, 0
    for turn in range(passes):

        def may(c0: Column, c: Column, turn=turn, careful=careful) -> Column:
            low, high = (F.xxhash64(x, F.lit(turn)) for x in (c0, c))
            return ((low % 2 == 0) & (high % 2 != 0)) if careful else low < high

        now = cut_lineage(wishes(sym, part, total, degree, may).withColumn("grade", grade))
        found = now.groupBy("grade").agg(F.sum("n").alias("n"), F.sum("g0").alias("g0"), F.count(F.lit(1)).alias("nodes"))
        sums = {r["grade"]: (r["n"], r["g0"], r["nodes"]) for r in found.collect()}
        height = sum(x[1] for x in sums.values())  # modularity, but for a factor and a constant
        if tried and height <= worth + EPS:
            part, tried, careful = kept, False, CAREFUL
            continue
        kept, worth = now.select("u", F.col("c0").alias("c")), height
        if GAINS not in sums:
            return cut_lineage(kept)
        links = sums[GAINS][0]
        tried, careful = links > most, max(0, careful - tried)
        if tried:
            part = cut_lineage(_stepped(now, total, sums[GAINS][2]))
            continue
        least, room = GAINS, most - links
        for x in sorted((x for x in sums if x is not None and x < GAINS), reverse=True):
            room -= sums[x][0]
            if room < 0:
                break
            least = x
        part = cut_lineage(_moved(sym, kept, now.where(F.col("grade") >= least), total))
    raise RuntimeError(f"communities did not settle in {passes} passes")


def _inside(sym: DataFrame, part: DataFrame) -> DataFrame:
    """Edges between members of one community."""
    near = part.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    return sym.join(part, "u").join(near, "v").where(F.col("c") == F.col("cv")).select("u", "v", "w")


def _pieces(sym: DataFrame, part: DataFrame) -> DataFrame:
    """Connected pieces of the communities."""
    inner = _inside(sym, part).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return cut_lineage(connected_components(inner, part.select(F.col("u").alias("wallet"))).toDF("u", "c"))


def _giant(sym: DataFrame, total: float, refine: bool, most: int, passes: int, levels: int) -> DataFrame:
    """Communities of components that don't fit a task: moves over tasks, contraction of the (for Leiden: refined) parts, level by level.

    Nodes go by numbers in the order of their names.
    """
    names = cut_lineage(ordered_scan(sym.select("u").distinct(), [], ["u"], index="id"))
    numbered = sym.join(names, "u").join(names.toDF("v", "to"), "v").select(F.col("id").alias("u"), F.col("to").alias("v"), "w")
    out = _giant_numbered(cut_lineage(numbered), total, refine, most, passes, levels)
    named = names.toDF("name", "u"), names.toDF("to", "c")
    return out.join(named[0], "u").join(named[1], "c").select(F.col("name").alias("u"), F.col("to").alias("c"))


def _giant_numbered(sym: DataFrame, total: float, refine: bool, most: int, passes: int, levels: int) -> DataFrame:
    nodes = cut_lineage(sym.select("u").distinct())
    flat, here = nodes.select("u", F.col("u").alias("s")), sym
    part = nodes.select("u", F.col("u").alias("c"))
    for _ in range(levels):
        part = local_moves(here, part, total, most, passes)
        sub = part
        if refine:
            alone = part.select("u", F.col("u").alias("c"))
            within = _inside(here, part)
            sub = _pieces(within, local_moves(cut_lineage(within), alone, total, most, passes))
        if sub.select("c").distinct().count() == sub.count():
            break
        cu, cv = sub.toDF("u", "cu"), sub.toDF("v", "cv")
        links = here.join(cu, "u").join(cv, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        flat = cut_lineage(flat.join(sub.toDF("s", "s2"), "s").select("u", F.col("s2").alias("s")))
        if refine:
            part = cut_lineage(sub.toDF("u", "s").join(part, "u").groupBy(F.col("s").alias("u")).agg(F.first("c").alias("c")))
        else:
            part = sub.select(F.col("c").alias("u"), "c").distinct()
        here = cut_lineage(links)
    else:
        raise RuntimeError(f"communities did not settle in {levels} levels")
    out = _pieces(sym, flat.join(part.toDF("s", "c"), "s").select("u", "c"))
    for _ in range(passes):
        if gaining(sym, out, total).isEmpty():
            return out
        out = _pieces(sym, local_moves(sym, out, total, most, passes))
    raise RuntimeError(f"communities did not settle in {passes} passes")


def communities(edges: DataFrame, nodes: DataFrame, refine: bool = False, most: int = MOST_LINKS, passes: int = 400, levels: int = 60) -> DataFrame:
    """``(wallet, community)`` of at least the modularity of the components: every community is connected, and no node gains by moving.

    A component of more than ``most`` links goes the way over tasks, and there nodes with more links than that move by ranks. Deterministic. A community is named after its smallest member.
    """
    base = nodes.select(F.col("wallet").alias("u")).distinct()
    sym = cut_lineage(undirected(edges))
    total = sym.agg(F.sum("w")).first()[0]
    if not total:
        return base.select(F.col("u").alias("wallet"), F.col("u").alias("community"))
    comp = cut_lineage(connected_components(edges).toDF("u", "g"))
    size = sym.join(comp, "u").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    big = cut_lineage(size.where(F.col("n") > most).select("g"))
    if big.isEmpty():
        part = _components_settled(sym, comp, total, refine)
    else:
        large = comp.join(big, "g", "left_semi")
        giant = _giant(cut_lineage(sym.join(large, "u", "left_semi").select("u", "v", "w")), total, refine, most, passes, levels)
        part = _components_settled(sym, comp.join(big, "g", "left_anti"), total, refine).unionByName(giant)
    part = cut_lineage(part)
    names = part.groupBy("c").agg(F.min("u").alias("name"))
    named = part.join(names, "c").select("u", "name")
    return base.join(named, "u", "left").select(F.col("u").alias("wallet"), F.coalesce("name", "u").alias("community"))


def louvain(edges: DataFrame, nodes: DataFrame, **limits) -> DataFrame:
    """GRA15: communities by local moves and contraction."""
    return communities(edges, nodes, False, **limits)


def leiden(edges: DataFrame, nodes: DataFrame, **limits) -> DataFrame:
    """GRA16: as Louvain, with parts refined inside their communities before they are contracted."""
    return communities(edges, nodes, True, **limits)


def partition_checks(edges: DataFrame, nodes: DataFrame, part: DataFrame) -> DataFrame:
    """One row: wallets covered, whether modularity is at least that of the components, whether all parts are connected, nodes that gain by moving."""
    p = cut_lineage(part.select(F.col("wallet").alias("u"), F.col("community").alias("c")))
    sym = cut_lineage(undirected(edges))
    total = sym.agg(F.sum("w")).first()[0] or 1.0
    whole = connected_components(edges, nodes).select(F.col("wallet").alias("u"), F.col("component").alias("c"))
    more = modularity(sym, p) >= modularity(sym, whole) - EPS
    pieces = _pieces(sym, p).select("c").distinct().count()
    return p.agg(
        F.countDistinct("u").alias("wallets"), F.lit(more).alias("above_components"), (F.countDistinct("c") == pieces).alias("connected"),
        F.lit(gaining(sym, p, total).count()).alias("gaining"),
    )
