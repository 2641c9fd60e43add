"""Conversation tries, ranked search and URL filters against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from samples import prose

from riskweave.llm import conversations, search, urls

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string, conv string, pos string, words string, a int, Depth int"


@pytest.mark.parametrize("name", ["op11_trie", "op12_search", "op13_urls"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry

    ok, _, _, note = compare(spark, connect(SMALL), SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


# ---- conversations -------------------------------------------------------------------------------------------


def told(rows):
    """{id: [(role, text)]} in the order of the turns."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in by.items()}


def trie(talks):
    """Brute force: one tuple per node."""
    members = defaultdict(list)
    for c, q in talks.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
    kids, under = Counter(), defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]] += 1
        for d in range(len(k) + 1):
            under[k[:d]].append(k)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(talks[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[u] for u in under[k]),
                    sum((len(members[u]) - 1) * words(u) for u in under[k]), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def nodes(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def talks():
    """Nulls, ties, repeated rows, empty texts, a long text, copies in large groups, long shared beginnings, one long conversation twice."""
    r, out = random.Random(8), []
    for c in range(1, 90):
        out += [(c, t, r.choice(["user", "assistant"]), r.choice(["yes", "no  no", "maybe so"])) for t in range(r.randrange(1, 5))]
    for c in range(100, 180):
        out += [(c, t, "user", f"turn {t}") for t in range(4)]
    for c in (200, 201, -7):
        out += [(c, t, "user" if t % 2 else "assistant", f"line {t} of many") for t in range(120)]
    out += [(202, t, "user" if t % 2 else "assistant", f"line {t} of many") for t in range(60)]
    out += [(300, None, None, None), (300, 1, None, "x"), (301, None, "", ""), (301, 1, "", "x"), (302, 1, "user", "tie b"), (302, 1, "user", "tie a")]
    out += [(303, 1, "user", "same"), (303, 1, "user", "same"), (304, 0, "user", prose(4, 30_000)), (None, 0, "user", "no id"), (305, 3, None, None)]
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "x", "y", "z", 1, 2) for t in talks()], TURNS).repartition(5).persist()


@pytest.mark.parametrize("hot", [None, 40])
def test_trie_equals_brute_force(spark, turns, monkeypatch, hot):
    if hot:  # conversations beyond 40 turns are scanned in pieces, endings are told in short pieces
        real = conversations.ordered_scan
        monkeypatch.setattr(conversations, "ordered_scan", lambda *a, **k: real(*a, **k, hot_rows=hot))
        monkeypatch.setattr(conversations.Shard, "PIECE", 10)
    seq = conversations.sequenced(turns)
    assert nodes(conversations.prefix_trie(seq, seq.select("conv").distinct())) == trie(told(talks()))


def test_heads_of_other_conversations(spark, turns):
    c = F.col("conv")
    got = conversations.prefix_trie(*conversations.joined_heads(conversations.sequenced(turns), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3))
    own, new = told(talks()), {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        new[c] = own.get(base, [])[:h] + q[h:]
    assert any(not q for q in new.values())
    assert nodes(got) == trie(new)


def test_trie_of_odd_tables(spark):
    none = conversations.sequenced(spark.createDataFrame([], TURNS))
    assert nodes(conversations.prefix_trie(none, none.select("conv"))) == Counter()
    one = conversations.sequenced(spark.createDataFrame([(5, 1, "user", "a b"), (5, 2, "user", "c")], "conv_id long, turn long, role string, text string"))
    assert nodes(conversations.prefix_trie(one, one.select("conv").distinct())) == trie({5: [("user", "a b"), ("user", "c")]})
    empty = nodes(conversations.prefix_trie(none, spark.createDataFrame([(3,), (1,)], "conv long")))
    assert empty == trie({1: [], 3: []})


# ---- search --------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked(docs, items, k=10):
    """Brute force: (item, rank, doc, score) tuples."""
    words = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(w > 0 for *_, w in words), sum(w for *_, w in words)
    df = Counter(t for _, c, _ in words for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c, w in words:
            m = 10 + 90 * w * n // max(total, 1)
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, *_, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return Counter(out)


ITEMS = [(1, "Alpha3 beta7, gamma11!"), (2, "alpha3 alpha3 ALPHA3 日本語 Ünï"), (2, "same text"), (3, None), (4, ""), (5, "absent terms only"), (None, "same here"),
         (None, "kappa1"), (6, prose(3, 200)), (7, "--- ... !!!"), (8, " ".join(f"omega{i}" for i in range(3000)))]


@pytest.mark.parametrize("size, most", [(1024, 4 << 20), (8, 300)])
def test_search_equals_brute_force(spark, odd, size, most):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = spark.createDataFrame([(i, t, 1, "s") for i, t in ITEMS], "item_id long, text string, rank int, score string")
    got = search.search(odd, items, size=size, most_bytes=most)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked(docs, ITEMS)


def test_search_of_many_copies_and_empty_tables(spark, odd, none):
    r = random.Random(2)
    docs = [(i, "copied words alpha beta") for i in range(300, 0, -1)] + [(1000 + i, " ".join(r.choices("alpha beta gamma delta copied".split(), k=r.randrange(9)))) for i in range(300)]
    items = [(1, "alpha beta"), (2, "copied words gamma")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), asked)
    assert Counter(map(tuple, got.collect())) == ranked(docs, items)
    assert search.search(none, asked).count() == 0 and search.search(odd, asked.where("false")).count() == 0


def test_bounds_leave_most_texts_unscored():
    """With the best texts known, those with lower bounds are not scored."""
    import numpy as np
    import pyarrow as pa

    texts = ["rare1 rare2 common"] * 10 + ["common filler"] * 500
    vocab = {b"rare1": 0, b"rare2": 1, b"common": 2}
    p = search.postings(pa.array(texts), vocab)
    weight = search.weights(510, np.array([10, 10, 510]))
    impact = search.impacts(p, weight, 510, 30 + 1000)
    sketch = search.sketched(p, impact, np.array([0, 1, 2]), 4)
    best = search.Best(1, 10)
    bounds = sketch @ np.array([[1.0], [1.0], [1.0], [0.0]])
    assert search.rescored(p, impact, bounds, [np.array([0, 1, 2])], np.arange(510), np.zeros(510, bool), best, step=10) == 10
    assert sorted(best.id[0]) == list(range(10))


# ---- urls ----------------------------------------------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", ""), ("allow", "net", "/en/deep/er"), ("block", "Example.COM", "/de"),
         ("allow", "org", "/x/"), ("block", "org", "/x/"), ("allow", "b.org", "/"), ("block", "org", "/long"), ("allow", "x.y", "/ab"), ("block", "y", "/abcd")]
URLS = [None, "", "no scheme", "http://", "://", "http://net", "http://net/", "https://EXAMPLE.net/en/1", "http://a.example.net", "http://a.example.net?q=/en/", "http://z.a.example.net/en/deep/er/x",
        "http://n.net/en/deep/erased", "http://net/en/deep/e", "http://example.com/de", "http://example.com/deep", "http://example.com/d", "http://notexample.com/de", "ftp://www.example.com/de#x",
        "http://c.org/x/y", "http://c.org/x", "http://b.org/long", "http://b.org/x/", "http://c.org/long?x://net/", "http://net:80/", "http://u@net/", "http://.net/", "http://net./", "http://a..net//en/",
        "http://x.y/abcd", "http://x.y/abc", "http://Ü.net/ß", "x" * 100_000 + "://net/" + "y" * 100_000, "http://net/a://org/x/", "http://net\n/"]


def verdict(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = host.translate(LOW)
    fits = [(len(h + p), h.count("."), v == "block", h.lower() + p, v) for v, h, p in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


@pytest.mark.parametrize("default", ["allow", "block"])
def test_urls_equal_brute_force(spark, default):
    rows = [(i, u, "h", "p", 3) for i, u in enumerate(URLS)] + [(None, "http://net/", "h", "p", 3), (2, "http://net/", "h", "p", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, RULE string, path int").repartition(3)
    want = Counter((i, *verdict(u, RULES, default)) for i, u, *_ in rows)
    assert Counter(map(tuple, urls.judged(pages, RULES, default=default).collect())) == want
    table = spark.createDataFrame(RULES, urls.RULES)
    for most in (1 << 20, 20):  # one trie, or several
        assert Counter(map(tuple, urls.judged(pages, table, default=default, most_bytes=most).collect())) == want


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert urls.judged(pages.where("false"), RULES).count() == 0
    for none in ([], spark.createDataFrame([], urls.RULES)):
        assert [tuple(r) for r in urls.judged(pages, none).collect()] == [(1, "net", "/", None, "allow")]
    with pytest.raises(ValueError):
        urls.judged(pages, [("maybe", "net", "/")])
    with pytest.raises(ValueError):
        urls.judged(pages, [("block", "", "/")])
