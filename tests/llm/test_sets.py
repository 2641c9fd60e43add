"""Near duplicates, decontamination, neighbours, pages, mixing, shards, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from samples import prose, rows

from riskweave.llm import decontaminate, dom, extraction, mixing, neardup, neighbours, setsketch, sharding

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(docs, share):
    """Brute force: {position: smallest id of its component} of (id, text) rows."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)].append(d)
    return [(docs[i][0], len(sets[i]), min(low[root(i)], default=None)) for i in range(len(docs))]


def chain():
    """Copies that drift: each alike to the next, the ends unlike; a hub with near copies unlike each other."""
    r, out = random.Random(4), []
    base = prose(1000, 200).split()
    for k in range(40):
        out.append((1000 + k, " ".join(base)))
        base[r.randrange(200)] = f"new{k}"
    hub = prose(2000, 120).split()
    for k in range(60):
        own = list(hub)
        own[r.randrange(120)] = f"one{k}"
        own[r.randrange(120)] = f"two{k}"
        out.append((2000 + k, " ".join(own)))
    return [(2999, " ".join(hub).upper()), *out, (3000, out[3][1]), (3001, out[3][1] + "  ")]


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, one id with two alike texts, copies and near copies whose ids are all null, empty texts."""
    base, other, third = prose(1, 120), prose(2, 120), prose(3, 80)
    docs = [(7, base, 1), (7, base, 1), (7, base + " end", 2), (9, base, 3), (None, base, 4), (None, other, 5), (None, other, 5), (None, other + " end", 6), (3, "", 7), (3, "", 7), (4, None, 8), (5, third, 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string, size int").repartition(4)
    left = neardup.deduplicated(table).collect()
    assert Counter(r.doc_id for r in left) == {7: 1, None: 1, 3: 2, 4: 1, 5: 1}
    assert all((r.doc_id, r.text, r.size) in docs for r in left)


@pytest.mark.parametrize("tile", [512, 16])
def test_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    docs = chain()
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.85).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(components(docs, 85))
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_near_duplicates_of_odd_tables(spark, odd, none, get):
    docs = [r[:2] for r in rows()]
    got = neardup.near_duplicates(odd).collect()
    want = [(i, n, c if n else i) for i, n, c in components(docs, 80)]
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    kept = neardup.deduplicated(odd)
    stay = Counter({i: 1 for i, n, c in want if n and i == c}) + Counter(i for i, n, _ in want if not n)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in get(kept)) == stay
    assert get(neardup.near_duplicates(none)) == [] and neardup.deduplicated(none).count() == 0


def test_sketches_estimate_similarity_and_merge():
    a, b = prose(1, 3000), prose(2, 700)
    first, h = setsketch.shingles(pa.array([a + " " + b, a, b, ""]))
    regs = setsketch.registers(first, h)
    assert (np.maximum(regs[1], regs[2])[np.maximum(regs[1], regs[2]) != regs[0]].size) <= 3 and not regs[3].any()
    n = np.diff(first).astype(float)
    less, more = (regs[0] < regs[1]).sum(), (regs[0] > regs[1]).sum()
    sims = setsketch.estimated(np.array([less]), np.array([more]), n[:1], n[1:2])
    assert abs(sims[0] - n[1] / n[0]) < 0.12


def hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[s : s + 10])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = word.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    names |= wins[tuple(w[s : s + k])]
        text = ",".join(sorted(map(str, names)))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [(1, prose(1, 37)), (10, " ".join(prose(5, 65).split()[10:22])), (2, "same text"), (3, None), (4, "..."), (5, prose(77, 40)), (6, "Here"), (7, prose(3, 51)), (7, prose(3, 51)), (9, "a A a a a a a a a a a a")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination_equals_brute_force(spark, odd, none, get, limit):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, words int")
    extra = spark.createDataFrame([(60, "x a a a A a a a a a a a a y same text. same text here", None, None, 0, 1, "x", "y", 2, "z", "w")], odd.schema)
    docs = odd.union(extra)
    got = decontaminate.contamination(docs, items, broadcast_bytes=limit).collect()
    want = hits([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert Counter((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    left = decontaminate.clean(docs, items, broadcast_bytes=limit)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(d for (d, *_, bad), n in want.items() for _ in range(n) if not bad)
    if limit:
        assert get(decontaminate.contamination(none, items)) == []
        assert not any(r["contaminated"] for r in get(decontaminate.contamination(docs, items.limit(0))))


def test_neighbours_reach_recall_and_break_ties(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 12)).round(3)
    x[7] = x[8] = x[9] * 2
    data = [(i, [float(v) for v in x[i]], "label") for i in range(1500)]
    data += [(3000, None, ""), (3050, [0.0] * 12, ""), (3100, [float("nan")] * 12, ""), (3150, [1.0, 2.0], ""), (3200, [None] + [1.0] * 11, ""), (3250, [float("inf")] * 12, ""), (None, [1.0] * 12, "")]
    got = neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string"), (F.col("id") % 50 == 0) | (F.col("id") == 9)).collect()
    n = np.sqrt((x * x).sum(1))
    hit, queries = 0, [*range(0, 1500, 50), 9]
    for q in queries:
        s = (x * x[q]).sum(1) / (n * n[q])
        s[q] = -2
        want = np.lexsort((np.arange(1500), -s))[:5]
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [g[0] for g in mine] == [1, 2, 3, 4, 5] and all(math.isclose(s[v], c, abs_tol=1e-12) for _, v, c in mine)
        hit += len({v for _, v, _ in mine} & set(want))
        if q == 9:
            assert [v for _, v, _ in mine][:2] == [7, 8]
    assert hit >= 0.9 * 5 * len(queries) and {g.query_id for g in got} == set(queries)


def test_neighbours_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (51, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(few, F.col("id") % 50 == 0).collect()
    assert sorted((g.query_id, g.rank, g.vec_id) for g in got) == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert neighbours.nearest(few.limit(0), F.col("id") % 50 == 0).count() == 0


def test_hilbert_visits_neighbouring_cells():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = grid[np.argsort(neighbours.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>';</script><style>p{}</style></head><body>%s</body></html>"


def test_parser_blocks():
    nodes, blocks = dom.parse("<p>a <b>b<p>c&amp;d&nbsp; e<ul><li>x<li>y</ul>tail<!-- no --><textarea>z</textarea><br>end<p></div>q &lt;i&gt;")
    assert [t for _, t in blocks] == ["a b", "c&d e", "x", "y", "tail", "end", "q <i>"] or [t for _, t in blocks] == ["a b", "c&d e", "x", "y", "tail end", "q <i>"]
    for broken in ("", "<", "<p", "</p></p>", "<!--", "<script>", "<a href='x", "<p>" * 3000, "&#0;&#x110000;&bogus;"):
        dom.features(dom.parse(broken)[0], 1)


def test_sibling_features_of_many_children():
    nodes, blocks = dom.parse("<body>" + "<p>a" * 300 + "<div>b</div>" * 2)
    body = next(i for i, n in enumerate(nodes) if n.tag == "body")
    kin = nodes[body].children
    x = dom.features(nodes, len(blocks))[:, len(dom.GROUPS) + dom.BUCKETS :]
    assert len(kin) == 302 and np.allclose(x[kin, 1], np.arange(302) / 302) and (x[kin, 2] == 302).all()
    assert x[kin, 3].tolist() == [300] * 300 + [2] * 2 and x[0, 1:4].tolist() == [0, 1, 1]


def test_decoding_never_keeps_below_rejected():
    r = np.random.default_rng(1)
    nodes, _ = dom.parse("<div>" * 4 + "t" + "</div><div><p>a<p>b</div>" * 3)
    number = {id(n): i for i, n in enumerate(nodes)}
    for _ in range(200):
        keep = dom.decode(nodes, r.random(len(nodes)))
        for i, n in enumerate(nodes):
            path = [keep[i]]
            while n.parent:
                n = n.parent
                path.append(keep[number[id(n)]])
            flips = "".join(map(str, map(int, path[::-1])))
            assert re.fullmatch("0*1*0*", flips)


def test_extraction(spark, get):
    long = " ".join(f"Sentence {i} of the story, told at length." for i in range(30))
    body = (
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class='ad'>Buy now.</div>"
        f"<article><h1>Head&amp;line</h1><p>{long}</p><p>Second  <b>part</b>.\n More text follows here, and here.</p></article>"
        "<footer>&copy; all</footer>"
    )
    extra = [(9001, "u", PAGE % body, 1), (9002, "u", None, 1), (9003, None, "", 1), (None, "u", PAGE % body, 1), (9001, "u", PAGE % body, 1), (9004, "u", "plain words", 1)]
    base = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit(1))
    pages = base.union(spark.createDataFrame(extra, base.schema))
    trees = extraction.train(pages, rounds=6)
    got = get(extraction.extract(pages, trees))
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    want = f"Head&line\n{long}\nSecond part. More text follows here, and here."
    assert [r["text"] for r in got if r["id"] == 9001] == [want, want] and [r["text"] for r in got if r["id"] in (9002, 9003)] == ["", ""]
    import html

    by = {r["id"]: r["text"] for r in got}
    for r in base.collect():
        a = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        a = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", a)]
        assert by[r.page_id] == "\n".join(x for x in a if x)
    assert get(extraction.extract(pages.limit(0), trees)) == []


def test_training_pages_are_rare_or_none(spark, get):
    long = " ".join(f"Sentence {i} of the story, told at length." for i in range(30))
    body = "<div class=x><a href=/a>Home</a></div><%s><h1>Head</h1><p>" + long + "</p></%s><div class=y><a href=/b>More</a></div>"
    schema = "page_id long, url string, html string"
    plain = [(i, "u", PAGE % (body % ("div", "div"))) for i in range(60)]
    trees = extraction.train(spark.createDataFrame(plain + [(i, "u", PAGE % (body % ("article", "article"))) for i in (97, 98, 99)] + [(96, "u", "<!--<article>--><p>a")], schema), most=2, rounds=2)
    assert isinstance(trees, extraction.Trees)
    pages = spark.createDataFrame(plain[:2] + [(70, "u", "<!--<main>--><p>a")], schema)
    none = extraction.train(pages)
    got = {r["id"]: r["text"] for r in get(extraction.extract(pages, none))}
    assert got == {0: f"Head\n{long}", 1: f"Head\n{long}", 70: ""}
    assert get(extraction.extract(pages.limit(0), extraction.train(pages.limit(0)))) == []


@pytest.mark.parametrize("name", ["op2_mix", "op5_decontaminate"])
def test_query_matches_sql(spark, name):
    from riskweave.llm import queries

    ok, _, _, note = compare(spark, connect(SMALL), SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_mix_meets_targets(odd, none, get):
    got = get(mixing.mixture(odd))
    assert len(got) == odd.count() and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    per = defaultdict(list)
    for r in got:
        per[r["src"]].append(r)
    total = sum(r["size"] for r in got)
    assert math.isclose(sum(v[0]["target"] for v in per.values()), total)
    for v in per.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) + 1e-6
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
    assert got == get(mixing.mixture(odd.repartition(7))) and get(mixing.mixture(none)) == []
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in got) and mixing.mixed(none).count() == 0
    odds = get(mixing.mixture(odd, pieces=3))
    assert odds == got


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_balanced_stable_and_gapless(spark, odd, none, get):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    t = sharding.shard(ids).toPandas()
    assert t["shard"].value_counts().between(2300, 2700).all() and set(t["shard"]) == set(range(8))
    moved = t[t.shard != t.grown_shard]
    assert set(moved.grown_shard) == {8} and 0.09 < len(moved) / len(t) < 0.13
    assert (sharding.jump(np.array([0, 1, 5, 1 << 40, 2**63 + 7], np.uint64), 13) == [plain_jump(k, 13) for k in (0, 1, 5, 1 << 40, 2**63 + 7)]).all()
    crc = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in get(sharding.shard(odd))}
    assert all(crc[r["doc_id"]] == (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in get(odd) if r["doc_id"] is not None)
    got = get(sharding.with_slots(sharding.shard(odd).select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard"), pieces=5))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == odd.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r["size"] for r in got if r["doc_id"] in (31, 32)} == {1} and {r["text_crc32"] for r in got if r["doc_id"] == 31} == {0}
    assert get(sharding.with_slots(sharding.shard(none).select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard"))) == []


def test_stages_on_odd_and_empty_tables(spark, odd, none, labels, tmp_path):
    import corpus_pipeline as p

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in p.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert set(docs.columns) - {"size"} <= set(out.columns), name
            assert out.count() <= 3 * docs.count()
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert {"shard", "grown_shard"} <= set(p.run(spark, str(tmp_path)).columns)


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p>", "<nav><li></li>", '<a x="', "<a ", "<a<", "<!", "<!--", "<i><div></i>", "</p>", "<td>", "<p><b>", "<script>", "&#", "<li><b>", "<a '\"<b \"'"])
def test_hostile_pages_take_time_in_line_with_their_size(piece):
    import time

    took = []
    for size in (50_000, 400_000):
        page = "<body><article><p>" + prose(1, 60) + "</p></article>" + piece * (size // len(piece))
        start = time.process_time()
        nodes, blocks = dom.parse(page)
        took.append(time.process_time() - start)
        assert len(nodes) >= 3 and any("alpha" in t for _, t in blocks)
    assert took[1] < 40 * took[0] + 1.0, took


def test_inline_elements_that_end_below_others():
    nodes, blocks = dom.parse("<body><div><b>one <i>two</b> three</i> four</div><p>five<div>six</p>seven<ul><li>a<li>b</ul></body>")
    assert [t for _, t in blocks] == ["one two three four", "five", "six", "seven", "a", "b"]


def test_bands_are_shuffled_once_and_without_their_keys_stored(spark):
    r = np.random.default_rng(4).integers(0, 60_000, (6, setsketch.M)).astype(np.uint16)
    r[1, :12], r[2, :12], r[4, 6:12] = r[0, :12], r[0, :12], r[3, 6:12]
    reps = spark.createDataFrame([(i, 10 + i, x.tobytes()) for i, x in enumerate(r)], "cls long, n long, regs binary")
    got = {(m.band, m.cls, m.tiles) for m in neardup.members(reps).collect()}
    assert {c for _, c, _ in got} == {0, 1, 2, 3, 4} and len(got) == 5 and {t for *_, t in got} == {1}
    assert {b for b, c, _ in got if c > 2} == {1} and len({b for b, c, _ in got if c < 3} & {0, 1}) == 1
    plan = neardup.banded(reps)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and neardup.banded(reps).count() == 6 * setsketch.BANDS
