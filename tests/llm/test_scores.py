"""Toxicity, token counts, language model, quality."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import prose

from riskweave.llm import lm, pitman_yor, quality, texts, tokens, toxicity
from riskweave.llm.common import held_out

SMALL = "/root/testdata/sf0.1"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_agree_with_a_regular_expression():
    given = ["Ab  cd\n", "", None, "é É\tx", " lead", "a\x0bb\x1fc", "日本 語"]
    got = texts.words(pa.array(given), texts.NOT_SPACE)
    flat = got.array.to_pylist()
    mine = [[w.decode() for w in flat[a:b]] for a, b in zip(got.first[:-1], got.first[1:])]
    assert mine == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for t in given]
    got = texts.words(pa.array(given).slice(3, 3), texts.ALNUM)
    assert [w.decode() for w in got.array.to_pylist()] == ["é", "É", "x", "lead", "a", "b", "c"]


def test_slices_keep_all_rows_and_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 30, 4, 4)] + [None])], ["t"])
    parts = list(texts.slices([batch, batch.slice(0, 0)], "t", 9))
    assert [v for p in parts for v in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 3]


def test_token_counts_equal_the_library(odd, none, get):
    P = pytest.importorskip("public_tokenizers")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    make = lambda: tokens.PieceCounter(P.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in get(odd))
    got = get(tokens.count_tokens(odd, make, limit=100))
    assert Counter((r["id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert get(tokens.count_tokens(none, make)) == []
    own = make()
    hard = ["a  b", " a", "a ", "  ", " ", "a ▁ b▁", "<s>x</s> <unk>", "\x00", "a　b", "x" * 5000, "\n\n a\t"]
    first, array = own.split(pa.array(hard))
    n = own.pieces(array.to_pylist())
    assert [int(n[a:b].sum()) for a, b in zip(first[:-1], first[1:])] == [len(sp.encode(t)) for t in hard]


def test_toxicity_finds_held_out_toxic_documents(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, lab, lambda i: ~held_out(i, 3))
    got = toxicity.toxicity(docs.join(lab.select("doc_id"), "doc_id", "left_semi"), model)
    t = got.join(lab.withColumnRenamed("doc_id", "id"), "id").where(held_out(F.col("id"), 3)).toPandas()
    assert t["score"].between(0, 1).all() and (t["predicted"] == (t["score"] >= 0.7)).all()
    assert t[t.toxic == 1].predicted.mean() > 0.9 and t[t.toxic == 0].predicted.mean() < 0.02


def test_toxicity_of_odd_tables(odd, none, labels, get):
    model = toxicity.train(odd, labels, lambda i: F.lit(True))
    got = get(toxicity.toxicity(odd, model))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    same = {r["id"]: r["score"] for r in got}
    assert same[31] == same[32] == same[33]
    assert get(toxicity.toxicity(none, model)) == []
    blank = toxicity.train(none, labels.limit(0), lambda i: F.lit(True))
    assert {r["score"] for r in get(toxicity.toxicity(odd, blank))} == {0.5}


def test_kneser_ney_is_a_distribution_and_shares_rare_words():
    m = toxicity.KneserNey.from_counts([(b"a", 0, 50), (b"b", 1, 50), (b"c", 0, 30), (b"c", 1, 30), (b"rare", 1, 1)])
    at = m.vocab
    assert at[b"b"] > 2.5 > 2 > at[b"rare"] > 0 > at[b"a"] and abs(at[b"c"]) < 0.2
    assert m.ratios(pa.array(["rare rarest new", None]))[1].tolist() == [at[b"rare"], m.unseen, m.unseen]


def test_table_counts_follow_their_conditional():
    d, a = 0.6, 0.8
    s = pitman_yor.log_stirling(d)
    assert np.isclose(np.exp(s[3, 1]), (1 - d) * (2 - d)) and np.isclose(np.exp(s[3, 3]), 1) and np.isclose(np.exp(s[3, 2]), 3 * (1 - d))
    draw = np.random.default_rng(1)
    t = pitman_yor.sample_tables(np.full(40_000, 3), np.full(40_000, a), d, s, draw)
    w = np.exp(s[3, 1:4]) * a ** np.arange(1, 4)
    assert np.allclose(np.bincount(t, minlength=4)[1:] / 40_000, w / w.sum(), atol=0.01)
    big = pitman_yor.sample_tables(np.array([0, 1, 10_000]), np.array([a] * 3), d, s, draw)
    assert big[0] == 0 and big[1] == 1 and 1 <= big[2] < 10_000


def test_spelling_sums_to_one():
    cell, n = pitman_yor.cells_of(pa.array([b"the", b"then", b"a", b"\xc3\xa9t"]), np.array([3, 1, 2, 1]))
    for model in pitman_yor.seat_spelling(cell, n, np.random.default_rng(2)):
        every = np.arange(pitman_yor.SYMBOLS)
        th = [np.zeros(257, int), np.full(257, ord("h")), np.full(257, ord("h") * 256 + ord("t")), np.full(257, (ord("h") * 256 + ord("t")) * pitman_yor.FAR)]
        p = model.probability(th, every)
        assert np.isclose(p.sum(), 1) and p[ord("e")] > 0.3


def test_parcels_round_trip():
    r = np.random.default_rng(5)
    h = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    z, c = r.integers(0, 9, 700).astype(np.uint16), r.integers(0, 1 << 40, 700)
    back = lm.opened(lm.pressed(lm.steps(h), z, c, np.zeros(0, np.float32)), np.uint64, np.uint16, np.int64, np.float32)
    assert (np.cumsum(back[0], dtype=np.uint64) == h).all() and (back[1] == z).all() and (back[2] == c).all() and not len(back[3])


def brute_base(docs, folds=5):
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), " "] for i, t in docs.items()}
    c = Counter(w for i, x in toks.items() if zlib.crc32(str(i).encode()) % folds != 1 for w in x)
    n, v = sum(c.values()), len(c)
    return {i: (len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, x in toks.items()}


def test_language_model_counts_and_beats_the_unigrams(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_base({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = lm.scored(docs, ~held_out(F.col("id"), 5)).toPandas().set_index("id")
    assert len(got) == len(want)
    for i, (n, known, total, base) in want.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
    out = got[[zlib.crc32(str(i).encode()) % 5 == 1 for i in got.index]]
    assert out.score.sum() > out.base_score.sum() and (got.score < 0).all()


def test_language_model_on_odd_tables(odd, none, get):
    got = get(lm.scored(odd, ~held_out(F.col("id"), 5)))
    assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
    assert all(r["n_tokens"] == 1 for r in got if r["id"] in (31, 32, 33))
    assert get(lm.scored(none, F.lit(True))) == []
    untaught = get(lm.scored(odd, F.lit(False)))
    assert {r["train_tokens"] for r in untaught} == {0} and all(np.isfinite(r["score"]) for r in untaught)


def test_quality_is_accurate_and_keeps_clean_documents(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.train(docs, lab, lambda i: ~held_out(i, 3))
    got = quality.score(docs, weights).select(F.col("row.doc_id"), "posterior").join(lab, "doc_id").where(held_out(F.col("doc_id"), 3)).toPandas()
    assert (got[got.quality == 1].posterior >= 0.5).mean() > 0.99 and (got[got.quality == 0].posterior < 0.5).mean() > 0.95


def test_sites_are_shrunk_and_hold_their_document_out(spark):
    rows = [("big", "p", 0.9)] * 500 + [("bad", "p", 0.1)] * 500 + [("one", "p", 0.0), (None, None, 1.0)] + [("big", "q", 0.0)]
    sites, m = quality.site_table(spark.createDataFrame(rows, "host string, path string, p double"))
    t = {(r.host, r.path): r for r in sites.collect()}
    assert abs(m - 0.5) < 0.01 and t["big", "p"].host_mean > 0.85 and t["bad", "p"].host_mean < 0.15
    assert 0.2 < t["one", "p"].host_mean < 0.5 < t[None, None].host_mean < 0.8


def test_quality_of_odd_tables(odd, none, labels, get):
    w = quality.train(odd, labels)
    got = get(quality.score(odd, w).select("row.doc_id", "evidence", "site", "posterior"))
    assert len(got) == odd.count() and all(0 < r["posterior"] < 1 for r in got)
    assert quality.good(odd, w).columns == odd.columns and quality.good(odd, w, threshold=0.0).count() == odd.count()
    assert get(quality.good(none, w)) == []
    assert len(get(quality.good(odd, quality.train(odd, labels.limit(0))))) <= odd.count()
    assert quality.features(pa.array([prose(1, 50), "go go go go go go go go", None])).shape == (3, 6)


def test_language_model_scores_depend_on_the_word_before(spark):
    texts = ["we see red then blue", "red then blue we see", "see we blue red then"] * 2
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["we see red then blue"] * 60 + texts)], "doc_id long, text string, lang string")
    got = {r.id: r for r in lm.scored(docs, F.col("id") < 60).collect()}
    straight, turned, mixed = (got[60 + i] for i in range(3))
    assert math.isclose(straight.base_score, mixed.base_score, rel_tol=1e-9) and straight.n_known == mixed.n_known == 6
    assert straight.score > turned.score + 1 > mixed.score + 2 and all(math.isclose(got[63 + i].score, got[60 + i].score, rel_tol=1e-6) for i in range(3))


def test_every_language_has_its_own_restaurant(spark):
    langs = "abcdef"
    rows = [(100 * i + j, " ".join(f"{z}{(7 * j + m * m) % 40}" for m in range(12)), z) for i, z in enumerate(langs) for j in range(90)]
    rows += [(1000 + i, " ".join(f"q{m} {z}{m % 9}" for m in range(40)), z) for i, z in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    got = {r.id: r.score for r in lm.scored(docs, F.col("id") < 1000).collect()}
    last = [got[1000 + i] for i in range(len(langs))]
    assert max(last) - min(last) < 6, last


def test_scores_do_not_depend_on_the_cut_into_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1)
    train = ~held_out(F.col("id"), 5)
    whole = {r.id: r for r in lm.scored(docs, train).collect()}
    monkeypatch.setattr(lm, "BLOCK", 60_000)
    cut = {r.id: r for r in lm.scored(docs.repartition(2, "source"), train).collect()}
    assert whole.keys() == cut.keys()
    for i, a in whole.items():
        assert (a.n_tokens, a.n_known, a.train_tokens) == (cut[i].n_tokens, cut[i].n_known, cut[i].train_tokens)
        assert math.isclose(a.score, cut[i].score, rel_tol=1e-9) and math.isclose(a.base_score, cut[i].base_score, rel_tol=1e-9)
    monkeypatch.setattr(lm, "RANGE", 20_000)
    many = {r.id: r for r in lm.scored(docs, train).collect()}
    assert all(math.isclose(a.base_score, many[i].base_score, rel_tol=1e-9) for i, a in whole.items())
    assert abs(sum(a.score - many[i].score for i, a in whole.items())) < 0.01 * abs(sum(a.score for a in whole.values()))


def test_keyed_seats_follow_their_distribution():
    d, a = 0.6, 1.5
    s = pitman_yor.log_stirling(d)
    key = texts.mix(np.arange(40_000, dtype=np.uint64))
    t = pitman_yor.keyed_tables(np.full(40_000, 3), np.full(40_000, a), d, s, key)
    w = np.exp(s[3, 1:4]) * a ** np.arange(1, 4)
    assert np.allclose(np.bincount(t, minlength=4)[1:] / 40_000, w / w.sum(), atol=0.01)
    c = np.array([0, 1, 10_000] * 2)
    again = pitman_yor.keyed_tables(c, np.full(6, a), d, s, np.repeat(key[:1], 6))
    assert again[:2].tolist() == [0, 1] and 1 < again[2] < 10_000 and again[:3].tolist() == again[3:].tolist()


def test_tables_of_words_before_are_drawn_again_under_the_fitted_model(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"a b{(i * j) % 7}" for j in range(1, 9)), "en") for i in range(40)], "doc_id long, text string, lang string")
    got = {}
    for n in (0, 1):  # without a sweep every dish has one table
        monkeypatch.setattr(lm, "SWEEPS", n)
        got[n] = {r.id: r.score for r in lm.scored(docs, F.col("id") < 30).collect()}
    assert got[0].keys() == got[1].keys() and all(abs(got[0][i] - got[1][i]) > 1e-6 for i in got[0])


def test_seats_hang_on_the_chance_of_the_word():
    b = lm.Block(lm.pressed(np.zeros(2, np.int32), np.zeros(1, np.int32), np.array([1, 1], np.int32), np.frombuffer(b"xy", np.uint8)))
    n = 3000
    b.ph, b.w, b.u = texts.mix(np.arange(n, dtype=np.uint64)), np.repeat([0, 1], n // 2), np.zeros(n, np.int64)
    told = lm.Told(np.arange(n), np.zeros(n, np.int64), np.full(n, 20), np.ones(n, bool), None, None)
    t = lm.seated(b, told, np.array([[5, 5]]), np.array([[0.9, 0.001]]), 0.5, 0)
    assert t.min() == 1 and t[: n // 2].mean() > t[n // 2 :].mean() + 1 and (lm.seats_found(told, pa.table({"kind": [lm.SEATS], "data": [lm.seats_kept(told, t, 1)]}), 1) == t).all()
