"""Operators against hand-worked and brute-force results on small inputs."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.config import Settings
from riskweave.functions import risk, text
from riskweave.functions.typology_names import label_of_rule, normalise_truth, truth_columns
from riskweave.operators import cleaning, clusters, cycles, filing, graph, typology
from riskweave.operators.betweenness import betweenness
from riskweave.operators.communities import leiden, local_moves, louvain, modularity, undirected
from riskweave.operators.components import connected_components
from riskweave.operators.ordered import exact_quantile, group_median, ordered_scan
from riskweave.operators.pagerank import pagerank
from riskweave.operators.rules.enrich import tag_flags
from riskweave.operators.rules.registry import RuleBook, completeness
from riskweave.operators.window24 import longest_hops, reconvergence
from riskweave.plans.scoring import SENDER_COPIES
from riskweave.plans.training import RULE_COLUMNS, training_data
from riskweave.session import prepare
from riskweave.sources.transfers import MissingColumns, check_columns


def edges(spark, pairs):
    rows = [(s, d, 1.0, i) for i, (s, d) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, amount double, n int").withColumn("timestamp", F.timestamp_seconds("n"))


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def test_fixture_graph(make_tx):
    tx = make_tx([("A", "B", 1500), ("B", "C", 750), ("A", "D", 3200), ("C", "E", 500), ("D", "A", 100)])
    m = {r["wallet"]: r for r in graph.node_metrics(graph.wallet_edges(tx)).collect()}
    assert (m["A"]["in_degree"], m["A"]["out_degree"], m["A"]["weighted_out"]) == (1, 2, 4700.0)
    assert m["A"]["balance_ratio"] == pytest.approx(-4600 / 4800)
    hops = {r["wallet"]: r["hop_count_in_window"] for r in longest_hops(tx).collect()}
    assert hops["A"] == 3


def test_self_transfer_gives_empty_graph(make_tx):
    assert graph.wallet_edges(make_tx([("A", "A", 5)])).count() == 0


@pytest.mark.parametrize("hot", [10_000, 6])
def test_ordered_scan_split_equals_plain(spark, hot):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(rng.randrange(50))) for i in range(200)]
    rows += [(None, 200 + i, float(i)) for i in range(9)]  # a null key is a group as well
    df = spark.createDataFrame(rows, "k string, o int, v double")
    args = dict(lag={"p": "v"}, lead={"n": "v"}, index="i", moments={"m": "v"}, running={"s": "v"})
    got = {r["o"]: r for r in ordered_scan(df, ["k"], ["o"], hot_rows=hot, **args).collect()}
    assert len(got) == 209
    for _, grp in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        vals = list(grp)
        for j, (_, o, v) in enumerate(vals):
            r, before = got[o], [x[2] for x in vals[:j]]
            assert r["i"] == j + 1 and r["s"] == pytest.approx(sum(before) + v)
            assert r["p"] == (before[-1] if before else None)
            assert r["n"] == (vals[j + 1][2] if j + 1 < len(vals) else None)
            if before:
                mean = sum(before) / j
                assert r["m_mean"] == pytest.approx(mean)
                assert r["m_std"] == pytest.approx((sum((x - mean) ** 2 for x in before) / j) ** 0.5, abs=1e-6)


def test_exact_quantile_and_median_in_pieces(spark):
    rng = random.Random(2)
    vals = [float(rng.randrange(300)) for _ in range(1500)]
    df = spark.createDataFrame([(v, i, i % 2) for i, v in enumerate(vals)], "v double, i int, g int")
    for q in (0.5, 0.9, 0.999):
        want = df.agg(F.percentile("v", F.lit(q))).first()[0]
        assert exact_quantile(df, "v", q, hot_rows=100) == pytest.approx(want)
    med = {r["g"]: r["m"] for r in group_median(df, ["g"], "v", "i", "m", hot_rows=100).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert med == want


def brute_cycles(pairs, limit):
    out = {}
    for s, d in pairs:
        out.setdefault(s, set()).add(d)
    found = set()

    def walk(root, path):
        for nxt in out.get(path[-1], ()):
            if nxt == root and len(path) > 1:
                found.add(tuple(path))
            elif nxt > root and nxt not in path and len(path) < limit:
                walk(root, path + [nxt])

    for n in out:
        walk(n, [n])
    return found


@pytest.mark.parametrize("n, m, limit", [(12, 40, 6), (12, 40, 7), (9, 30, 10), (40, 60, 10), (6, 5, 2)])
def test_simple_cycles_match_brute_force(spark, n, m, limit):
    pairs = random_pairs(n, m, 3)
    got = [tuple(r["path"]) for r in cycles.simple_cycles(edges(spark, pairs), limit).collect()]
    assert Counter(got) == Counter(brute_cycles(pairs, limit))


@pytest.mark.parametrize("most", [0, 35])
def test_cycles_of_larger_components_are_joined_and_others_walked_in_tasks(spark, most):
    pairs = random_pairs(12, 40, 3) + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("w", "x"), ("w", "n00"), ("z", "z")]
    got = [(tuple(r["path"]), r["length"]) for r in cycles.simple_cycles(edges(spark, pairs), 7, most).collect()]
    assert Counter(got) == Counter((p, len(p)) for p in brute_cycles([p for p in pairs if p[0] != p[1]], 7))


@pytest.mark.parametrize("most", [1000, 5])
def test_strong_links_are_those_on_cycles(spark, most):
    pairs = random_pairs(40, 55, 9) + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a")]
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def reaches(a, b):
        seen, stack = set(), [a]
        while stack:
            for x in out[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        return b in seen

    got = {(r.src, r.dst) for r in cycles.strong_links(edges(spark, pairs), most).collect()}
    assert got == {(a, b) for a, b in pairs if reaches(b, a)} and ("c", "d") not in got


@pytest.mark.parametrize("n, m", [(10, 30), (9, 55), (8, 56)])
def test_ego_cycles_match_brute_force(spark, n, m):
    pairs = random_pairs(n, m, 4)
    got = {r["wallet"]: r for r in cycles.ego_cycles(edges(spark, pairs)).collect()}
    nodes = {x for p in pairs for x in p}
    for w in nodes:
        ego = {w} | {b for a, b in pairs if a == w} | {a for a, b in pairs if b == w}
        inner = [(a, b) for a, b in pairs if a in ego and b in ego]
        for limit in (3, 4, 5, 6):
            want = sum(w in c for c in brute_cycles(inner, limit))
            assert got[w][f"n{limit}"] == want, (w, limit)


def brute_hops(rows):
    """Longest walks from (sender, receiver) rows in the order of time."""
    best: dict = {}
    for s, r in reversed(rows):
        best[s] = max(best.get(s, 0), 1 + best.get(r, 0))
    return best


@pytest.mark.parametrize("slice_rows, most_pairs", [(10**6, 10**6), (40, 10**6), (10**6, 30), (70, 25)])
def test_longest_walks_over_slices(spark, make_tx, slice_rows, most_pairs):
    rng = random.Random(12)
    rows = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(300)]
    got = {r["wallet"]: r["hop_count_in_window"] for r in longest_hops(make_tx([(*x, 1.0) for x in rows]), slice_rows, most_pairs).collect()}
    assert got == brute_hops(rows)


def test_longest_walk_of_one_busy_pair(spark):
    """50,000 transfers to and fro in a day: one walk of 50,000 steps, put together from six slices."""
    n = F.col("id")
    tx = spark.range(50_000).select(
        F.when(n % 2 == 0, "a").otherwise("b").alias("sender_wallet"), F.when(n % 2 == 0, "b").otherwise("a").alias("receiver_wallet"), F.timestamp_seconds(n).alias("timestamp"), n.alias("ord")
    )
    got = {r["wallet"]: r["hop_count_in_window"] for r in longest_hops(tx, 9_000).collect()}
    assert got == {"a": 50_000, "b": 49_999}
    assert longest_hops(tx.where("false")).count() == 0


@pytest.mark.parametrize("hub", [10_000, 3])
def test_two_hop_counts_with_and_without_hubs(spark, hub):
    pairs = random_pairs(30, 70, 5)
    nb = graph.neighbours(edges(spark, pairs))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {w: len(set().union(*(near[u] for u in near[w])) - {w}) for w in near}
    got = {r["wallet"]: r["n2"] for r in graph.two_hop_counts(nb, nb.select("wallet").distinct(), hub).collect()}
    assert got == {w: n for w, n in want.items() if n}


@pytest.mark.parametrize("hub, most_reach", [(10_000, 7), (4, 7), (4, 1_000_000), (6, 1)])
def test_two_hop_counts_send_lists_and_no_pairs(spark, monkeypatch, hub, most_reach):
    """Wallets reached are told as lists and counted in tasks; wide wallets are dealt over slices, some wallets are asked alone."""
    pairs = random_pairs(40, 160, 9) + [("hub", f"n{i}") for i in range(0, 40, 2)]
    nb = graph.neighbours(edges(spark, pairs))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = sorted(near)[::2] + ["hub"]
    dealt = []
    counted = graph._distinct_reached
    monkeypatch.setattr(graph, "_distinct_reached", lambda n: dealt.append(n) or counted(n))
    got = {r["wallet"]: r["n2"] for r in graph.two_hop_counts(nb, spark.createDataFrame([(w,) for w in asked], "wallet string"), hub, most_reach).collect()}
    want = {w: len(set().union(*(near[u] for u in near[w])) - {w}) for w in asked}
    assert got == {w: n for w, n in want.items() if n}
    assert dealt == [len(near)]


def test_prepared_sessions_cut_up_methods_that_are_never_compiled(spark):
    """The limit is Spark's default or the caller's own value until a session is prepared; the caller's own one stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    other = spark.newSession()
    other.conf.unset(limit)
    assert prepare(other).conf.get(limit) == "8000"
    other.conf.set(limit, "4000")
    assert prepare(other).conf.get(limit) == "4000"


@pytest.mark.parametrize("hub", [10_000, 2])
def test_reconvergence_with_and_without_hubs(spark, hub):
    pairs = random_pairs(18, 80, 6)
    succ = {}
    for a, b in pairs:
        succ.setdefault(a, set()).add(b)
    got = {r["wallet"]: r["reconvergence_score"] for r in reconvergence(edges(spark, pairs), hub).collect()}
    for w, kids in succ.items():
        k = len(kids)
        shared = sum(bool(succ.get(a, set()) & succ.get(b, set())) for a, b in itertools.combinations(kids, 2))
        assert got[w] == pytest.approx(shared / (k * (k - 1) / 2) if k > 1 else 0.0), w


def test_components_close_under_edges(spark):
    pairs = random_pairs(60, 45, 7)
    comp = {r["wallet"]: r["component"] for r in connected_components(edges(spark, pairs)).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((find(a), find(b)))
        root[rb] = ra
    assert comp == {x: find(x) for x in root}


def test_pagerank_and_betweenness_on_a_path(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    nodes = graph.nodes_of(e)
    assert pagerank(e, nodes).agg(F.sum("pagerank")).first()[0] == pytest.approx(1.0)
    b = {r["wallet"]: r["betweenness"] for r in betweenness(e, nodes).collect()}
    assert b == pytest.approx({"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0})


def test_betweenness_batches_by_what_paths_can_reach(spark, monkeypatch):
    """Forty paths and a ring with a chord: inside tasks and by joins alike, and sources of small components share one batch."""
    from riskweave.operators import betweenness as module

    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r0"), ("r0", "r2")]
    e = edges(spark, [x for i in range(40) for x in ((f"p{i}a", f"p{i}b"), (f"p{i}b", f"p{i}c"))] + ring)
    nodes, calls, real = graph.nodes_of(e), [], module._dependencies
    monkeypatch.setattr(module, "_dependencies", lambda *a: calls.append(a) or real(*a))
    inside = {r["wallet"]: r["betweenness"] for r in betweenness(e, nodes).collect()}
    assert not calls
    joined = {r["wallet"]: r["betweenness"] for r in betweenness(e, nodes, most_rows=500, most_steps=0).collect()}
    assert len(calls) == 1 and joined == pytest.approx(inside)
    n = len(inside)
    want = {"r0": 3, "r1": 0, "r2": 3, "r3": 3, "p7a": 0, "p7b": 1, "p7c": 0}
    assert {k: inside[k] * (n - 1) * (n - 2) for k in want} == pytest.approx(want)


def test_communities_cover_nodes(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(4) if i != j]
    e = edges(spark, clique("a") + clique("b") + [("a0", "b0")])
    nodes = graph.nodes_of(e).unionByName(spark.createDataFrame([("alone",)], "wallet string"))
    for find, limits in ((louvain, (1000, 20)), (leiden, (1000,))):
        for most in limits:  # in one task, and by grouped moves
            part = {r["wallet"]: r["community"] for r in find(e, nodes, most=most).collect()}
            assert part["a1"] == part["a3"] == "a0" != part["b2"] == part["b1"] and len(part) == 9 and part["alone"] == "alone"
    assert modularity(undirected(e), spark.createDataFrame([(w, c) for w, c in part.items()], "u string, c string")) > 0.3
    none = e.where("false")
    assert louvain(none, nodes).where("wallet <> community").isEmpty()


def test_many_nodes_move_in_one_pass(spark):
    """A random graph whose links exceed the limit of a task many times settles in a few dozen passes, and no node gains."""
    from riskweave.operators.communities import degrees, gaining, local_moves

    rng = random.Random(3)
    e = edges(spark, sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(500)) if a != b}))
    sym = undirected(e).cache()
    total = sym.agg(F.sum("w")).first()[0]
    alone = degrees(sym).select("u", F.col("u").alias("c"))
    part = local_moves(sym, alone, total, most=60, passes=45)
    assert part.count() == alone.count() and gaining(sym, part, total).isEmpty()
    assert modularity(sym, part) > 0.2


def test_neighbours_do_not_change_places(spark):
    """On a lattice all nodes gain alike: moved without ranks they change places with their neighbours, and modularity stayed at 0.25."""
    pairs = [(f"n{i:03d}", f"n{j % 400:03d}") for i in range(400) for j in (i + 1, i + 7, i + 31)]
    sym = undirected(edges(spark, pairs)).cache()
    alone = sym.select("u", F.col("u").alias("c")).distinct()
    assert modularity(sym, local_moves(sym, alone, sym.agg(F.sum("w")).first()[0], most=60, passes=40)) > 0.33


def quality(near, part):
    """(gain of the best single move, whether all parts are connected, modularity)."""
    total = sum(map(len, near.values()))
    volume, members = Counter(), defaultdict(set)
    for u, c in part.items():
        volume[c] += len(near[u])
        members[c].add(u)
    best = 0.0
    for u, c in part.items():
        k = len(near[u])
        gain = {x: sum(part[v] == x for v in near[u]) - k * (volume[x] - (k if x == c else 0)) / total for x in {c, *(part[v] for v in near[u])}}
        best = max(best, max(gain.values()) - gain[c])
    whole = True
    for m in members.values():
        seen, stack = set(), [min(m)]
        while stack:
            u = stack.pop()
            if u not in seen:
                seen.add(u)
                stack += [v for v in near[u] if v in m]
        whole &= seen == m
    q = sum(sum(part[v] == c for v in near[u]) for u, c in part.items()) / total - sum((v / total) ** 2 for v in volume.values())
    return best, whole, q


@pytest.mark.parametrize("find, most, n", [(louvain, 10_000, 90), (leiden, 10_000, 90), (louvain, 90, 30), (leiden, 90, 30)])
def test_communities_are_connected_and_stable(spark, find, most, n):
    """Two random graphs, a ring of cliques and a star with pendant paths; the ring, of more than 90 links, by grouped moves over levels."""
    r = random.Random(11)
    pairs = random_pairs(n, 2 * n // (1 if n > 30 else 2), 5) + [(f"x{a}", f"x{b}") for a, b in random_pairs(30, 25, 6)]
    for i in range(8):
        pairs += [(f"q{i}_{a}", f"q{i}_{b}") for a in range(5) for b in range(a)] + [(f"q{i}_0", f"q{(i + 1) % 8}_1")]
    for i in range(n // 3):
        pairs += [("hub", f"s{i}"), (f"s{i}", f"t{i}"), (f"t{i}", f"s{r.randrange(n // 3)}")]
    e = edges(spark, [p for p in pairs if p[0] != p[1]])
    nodes = graph.nodes_of(e)
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[str(a)].add(str(b))
            near[str(b)].add(str(a))
    part = {x["wallet"]: x["community"] for x in find(e, nodes, most=most).collect()}
    assert part.keys() == near.keys()
    best, whole, q = quality(near, part)
    comp = {x["wallet"]: x["component"] for x in connected_components(e, nodes).collect()}
    assert best < 1e-8 and whole and q >= quality(near, comp)[2]
    assert q > 0.6 and all(len({part[f"q{i}_{a}"] for a in range(5)}) == 1 for i in range(8))


def test_moves_raise_when_they_do_not_settle(spark):
    sym = undirected(edges(spark, random_pairs(150, 300, 3))).persist()
    alone = sym.select("u", F.col("u").alias("c")).distinct()
    with pytest.raises(RuntimeError):
        local_moves(sym, alone, sym.agg(F.sum("w")).first()[0], passes=1)


@pytest.mark.parametrize("hot", [10**6, 500])
def test_tags_hold_between_their_bounds(spark, make_tx, hot):
    """10,000 overlapping tags on one wallet, open bounds, touching bounds, a bound before its beginning."""
    tx = make_tx([("hub", f"n{i % 40}", 5.0) for i in range(300)] + [("a", "a", 1.0), ("b", "tagged", 1.0), ("c", "late", 1.0), ("d", "never", 1.0)])
    t0 = 1_704_067_200
    at = {r.receiver_wallet: int(r.timestamp.timestamp()) for r in tx.collect() if r.receiver_wallet in ("a", "tagged", "late", "never")}
    tags = [("hub", "Scam", t0 + 7 * i % 9000, t0 + 7 * i % 9000 + i % 50) for i in range(9_990)]
    tags += [("a", "mixer", None, None), ("tagged", "darknet", at["tagged"], at["tagged"]), ("late", "sanctioned", at["late"] + 1, None), ("never", "ransomware", at["never"] + 1, at["never"] - 1)]
    tags += [("never", "exchange", None, at["never"]), ("n3", "unknown", None, None), ("n5", "gambling", None, t0 + 60 * 50)]
    table = spark.createDataFrame(tags, "wallet_address string, tag string, f long, t long").select(
        "wallet_address", "tag", F.timestamp_seconds("f").alias("valid_from"), F.timestamp_seconds("t").alias("valid_to"))
    want = defaultdict(set)
    for r in tx.collect():
        when = int(r.timestamp.timestamp())
        for address, party in ((r.sender_wallet, r.receiver_wallet), (r.receiver_wallet, r.sender_wallet)):
            if address not in ("hub", "a", "tagged", "late", "never", "n5"):
                continue
            for w, kind, f, t in tags:
                if w == address and (f is None or when >= f) and (t is None or when <= t):
                    want[address].add(kind.lower())
                    want[party].add(kind.lower())
    got = {r.wallet: r for r in tag_flags(tx, table, hot_rows=hot).collect()}
    assert got.keys() == want.keys()
    for w, kinds in want.items():
        assert got[w].tag_risky == bool(kinds - {"exchange"}) and got[w].near_exchange == ("exchange" in kinds)
        assert all(got[w][f"tag_{k}"] == (k in kinds) for k in ("sanctioned", "ransomware", "scam", "darknet"))


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([("hub", f"d{i}") for i in range(4)], "fan-out"),
        ([(f"s{i}", "sink") for i in range(6)], "many-to-one collection"),
        ([(f"p{i}", f"p{i + 1}") for i in range(5)], "peel chain"),
        ([("a", "b"), ("b", "c"), ("c", "a")], "circular loop / round-tripping"),
        ([("src", "a"), ("src", "b"), ("a", "sink"), ("b", "sink"), ("a", "x"), ("b", "y")], "reconsolidation"),
    ],
)
def test_structure_goldens(spark, pairs, want):
    e = edges(spark, pairs)
    mem = graph.nodes_of(e).withColumn("cluster_id", F.lit("c"))
    got = typology.structure_typology(clusters.cluster_edges(e, mem), clusters.member_degrees(e, mem)).first()["structure"]
    assert got == want


def test_flow_roles_guarantee_source_and_exit(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    mem = graph.nodes_of(e).withColumn("cluster_id", F.lit("c"))
    assert {r["wallet"]: r["role"] for r in clusters.flow_roles(e, mem).collect()} == {"a": "source", "b": "exit", "c": "layer"}


def test_levels_and_labels(spark):
    from riskweave.config import Thresholds

    df = spark.createDataFrame([(0.95,), (0.9,), (0.6,), (0.5,), (0.4,), (0.3,), (0.2,), (None,)], "s double")
    t = Thresholds(0.5, 0.9, 0.3)
    got = [r[0] for r in df.select(risk.level_from_score(F.col("s"), t)).collect()]
    assert got == ["high", "high", "medium", "medium", "medium-low", "low", "low", "low"]
    words = spark.createDataFrame([("fan-out dispersal",), ("Bridge hop",), ("nothing",), (" ",)], "s string")
    assert [r[0] for r in words.select(normalise_truth(F.col("s"))).collect()] == ["fan-out", "cross-chain bridge hop", None, None]
    names = spark.createDataFrame([("PeelChain",), ("BridgeHopObfuscation",), ("CashStructuring",)], "s string")
    assert [r[0] for r in names.select(label_of_rule(F.col("s"))).collect()] == ["peel chain", "cross-chain bridge hop", None]
    assert truth_columns(["amount", "AML Pattern", "heuristic_top_typology"]) == ["AML Pattern"]


def test_id_lists(spark):
    df = spark.createDataFrame([(None,), ("[]",), ("[1, 5]",), ("not json",), ("  ",)], "s string")
    assert [r[0] for r in df.select(text.parse_id_list(F.col("s"))).collect()] == [[], [], [1, 5], [], []]


def test_cleaning_dirty_rows(spark):
    rows = [("t1", None, "B", "abc", "2024-01-01 00:00:00"), ("t2", "A", "B", "oops", "2024-01-01 00:00:00"), ("t3", "A", "B", "5", None)]
    df = spark.createDataFrame(rows, "transaction_id string, sender_wallet string, receiver_wallet string, amount string, timestamp string")
    out = cleaning.clean(df).collect()
    assert [(r["transaction_id"], r["amount"]) for r in out] == [("t2", 0.0)]
    with pytest.raises(MissingColumns) as err:
        check_columns(spark.createDataFrame([("1", "a", "b")], "id string, sender string, receiver string"))
    assert "amount" in str(err.value)


def test_rule_book(spark):
    book = RuleBook.standard()
    assert len(book.info) == 185 and len(book.logic) == 48
    assert completeness(book.table(spark)).count() == 0
    with pytest.raises(ValueError):
        book.register(1, "Again", "traditional", [], [], F.lit(True), F.lit(1.0))


def test_filing_status(spark):
    rec = spark.createDataFrame([("r1", "draft", None)], "record_id string, status string, filing_date timestamp")
    assert filing.set_status(rec, F.lit(True), "filed").first()["filing_date"] is not None
    with pytest.raises(ValueError):
        filing.set_status(rec, F.lit(True), "lost")


def test_empty_input(make_tx, spark):
    from riskweave.operators.tx_features import transaction_features
    from riskweave.operators.window24 import window_features

    none = make_tx([("A", "B", 1)]).where(F.lit(False))
    assert transaction_features(none).count() == 0
    assert window_features(none).count() == 0
    assert connected_components(graph.wallet_edges(none)).count() == 0


def test_small_pipeline(make_tx):
    from riskweave.plans.scoring import run_pipeline

    tx = make_tx([("hub", f"d{i}", 500 + i) for i in range(12)] + [("d1", "hub", 400), ("d2", "d3", 9000)])
    run = run_pipeline(tx, Settings(hot_rows=5), as_of=F.lit("2024-06-01").cast("timestamp"), communities="components")
    hub = run.scores.where(F.col("sender_wallet") == "hub").first()
    assert 92 in hub["triggered_ids"] and 0 <= hub["meta_score"] <= 1
    assert run.clusters.count() == 1


def test_long_labels_are_prepared_once_for_all_patterns(spark):
    texts = ["a  Many\tgo to one", "Cross the CHAIN", "fan it out", " round  trip ", "off the exit ramp", "peel", "layers", "nothing", " ", "\n", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalise_truth(F.col("t")).alias("label"))
    want = ["many-to-one collection", "cross-chain bridge hop", "fan-out", "circular loop / round-tripping", "offramp exits", "peel chain", "layering"]
    assert [r.label for r in df.orderBy("i").collect()] == want + [None] * 5
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_vectors_of_small_communities_are_dealt_whole(spark):
    import numpy as np

    embedding_spread = clusters.embedding_spread

    draw = np.random.default_rng(3)
    vectors = {f"w{i}": [None if draw.random() < 0.2 else float(x) for x in draw.normal(size=5 if i % 3 else 3)] for i in range(12)}
    place = {f"w{i}": "abc"[i // 4 if i < 8 else 2] if i != 11 else "d" for i in range(12)}
    vectors["w11"], place["w12"] = [None, None], "d"
    vectors["w12"], place["w13"] = [], "e"
    vectors["w13"] = []
    m = spark.createDataFrame([(c, w) for w, c in place.items()], "cluster_id string, wallet string")
    e = spark.createDataFrame(list(vectors.items()), "wallet string, embedding array<double>")
    want = {}
    for c in "abcd":
        dims = [[v[i] for w, v in vectors.items() if place[w] == c and i < len(v) and v[i] is not None] for i in range(5)]
        dims = [x for x in dims if x]
        want[c] = (sum(np.mean(x) ** 2 for x in dims) ** 0.5, np.mean([np.std(x) for x in dims]) if dims else 0.0)
    for most in (100, 3, 0):
        got = {r.cluster_id: (r.emb_mean_norm or 0.0, r.emb_std_mean or 0.0) for r in embedding_spread(m, e, most).collect()}
        assert all(np.allclose(got[c], want[c]) for c in "abcd") and got.get("e", (0.0, 0.0)) == (0.0, 0.0)
    plan = embedding_spread(m, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Generate" not in plan


def test_small_hot_groups_do_not_make_a_task_per_few_rows(spark, monkeypatch):
    from riskweave.operators import ordered

    cuts = []
    keep = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: cuts.append(df.rdd.getNumPartitions()) or keep(df))
    rows = [(k, i, float(i * 7 % 11)) for k in range(5) for i in range(40 + k)] + [(9, 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, o int, x double")
    args = dict(lag={"p": "x"}, lead={"q": "x"}, index="i", running={"r": "x"})
    got = {tuple(r) for r in ordered_scan(df, ["k"], ["o"], hot_rows=3, **args).collect()}
    assert got == {tuple(r) for r in ordered_scan(df, ["k"], ["o"], **args).collect()} and len(got) == len(rows)
    assert cuts and max(cuts) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_training_features_are_of_representative_edges(make_tx):
    tx = make_tx([("B", "X", 500), ("B", "A", 700), ("A", "C", 90), ("A", "D", 40), ("S", "S", 10), ("X", "B", 20)])
    label = F.when(F.col("ord") == 1, "illicit").when(F.col("ord").isin(2, 4), "licit")
    data = training_data(tx.withColumn("label", label), as_of=F.current_timestamp(), per_node=True)
    got = {r["primary_node"]: r for r in data.rows.collect()}
    assert {w: (r["sender_wallet"], r["receiver_wallet"], r["label"]) for w, r in got.items()} == {"A": ("A", "C", 1), "B": ("B", "A", 1), "C": ("A", "C", 0)}
    node = {r["wallet"]: r for r in data.nodes.collect()}
    assert all(r[c] == node[w][c] for w, r in got.items() for c in SENDER_COPIES) and node["C"]["in_degree"] != node["A"]["out_degree"]
    assert (got["A"]["amount"], got["B"]["amount"], got["C"]["amount"]) == (700.0, 700.0, 90.0) and got["C"]["sender_tx_count"] == 2
    assert all(r[c] is not None for r in got.values() for c in RULE_COLUMNS)
