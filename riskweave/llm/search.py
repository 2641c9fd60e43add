"""Ranked lexical search: hashed sketches of largest impacts bound the scores, exact scores follow in descending order of bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, inner_names, written
from .texts import ALNUM, hashes, slices, words

#: Terms of the queries: runs of digits, letters and characters beyond ASCII, as in ``texts.ALNUM``.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LAST = np.int64(np.iinfo(np.int64).max)  # a null id ranks behind the others


@dataclass
class Batch:
    """Queries of one round: their ids, the distinct terms, and which terms each query holds."""

    ids: list
    terms: dict[bytes, int]
    of: list[np.ndarray]


def batches(queries: DataFrame, most_bytes: int, most_rows: int = 4096) -> Iterator[Batch]:
    """Queries (id, t) in rounds of about ``most_bytes`` of text and ``most_rows`` rows; rows that share an id are one query."""
    size, rows = queries.agg(F.sum(F.octet_length("t")), F.count("t")).first()
    if not size:
        return
    rounds = max(-(-size // most_bytes), -(-rows // most_rows))
    for r in range(rounds):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).where("t IS NOT NULL").collect()
        terms: dict[bytes, int] = {}
        held: dict = {}
        for id, text in rows:
            held.setdefault(id, set()).update(words(pa.array([text]), ALNUM).array.to_pylist())
        held = {i: t for i, t in held.items() if t}
        of = [np.array(sorted(terms.setdefault(t, len(terms)) for t in sorted(h)), np.int64) for h in held.values()]
        yield Batch(list(held), terms, of)


@dataclass
class Postings:
    """Terms of the queries in some texts: (text, term, times) sorted by text and term, and each text's number of terms."""

    key: np.ndarray
    times: np.ndarray
    n: np.ndarray
    width: int

    @property
    def text(self) -> np.ndarray:
        return self.key // self.width

    @property
    def term(self) -> np.ndarray:
        return self.key % self.width


def postings(column: pa.Array, terms: dict[bytes, int]) -> Postings:
    w = words(column, ALNUM)
    code, distinct = w.coded()
    known = np.fromiter((terms.get(t, -1) for t in distinct), np.int64, len(distinct))
    n = np.diff(w.first)
    term = known[code] if len(code) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(column)), n)[term >= 0]
    width = max(len(terms), 1)
    key, times = np.unique(text * width + term[term >= 0], return_counts=True)
    return Postings(key, times, n, width)


def counted(docs: DataFrame, batch: Batch) -> tuple[int, int, np.ndarray]:
    """(texts with a term, all terms, texts per query term) over all ``docs`` (id, t). One row per task and term is summed."""
    terms = docs.sparkSession.sparkContext.broadcast(batch.terms)

    def run(rows):
        n = total = 0
        df = np.zeros(len(terms.value), np.int64)
        for b in rows:
            for part in slices(iter([b]), "t"):
                p = postings(part.column("t"), terms.value)
                n += int((p.n > 0).sum())
                total += int(p.n.sum())
                df += np.bincount(p.term, minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())], names=["term", "n"])

    got = in_arrow(docs.select("t"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in got}
    df = np.zeros(len(batch.terms), np.int64)
    for t, k in found.items():
        if t >= 0:
            df[t] = k
    return found.get(-2, 0), found.get(-1, 0), df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """Whole-number weight of each term: rarer ones weigh more, none less than 0."""
    return np.fromiter((floor(1000 * log((2 * n + 2) / (2 * int(d) + 1))) for d in df), np.int64, len(df))


def impacts(p: Postings, weight: np.ndarray, n: int, total: int) -> np.ndarray:
    """What each posting adds to a score: the term's weight times its share, which grows with its occurrences and falls with the text's length."""
    m = 10 + (90 * p.n * n) // max(total, 1)
    tf = p.times.astype(np.int64)
    return weight[p.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[p.text]))


class Best:
    """The best (score, id) pairs per query so far, best first."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.full((queries, k), LAST)
        self.nulls = np.zeros((queries, k), bool)

    def add(self, q: int, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        s, i, z = np.r_[self.score[q], score], np.r_[self.id[q], id], np.r_[self.nulls[q], null]
        top = np.lexsort((i, -s))[: self.score.shape[1]]
        self.score[q], self.id[q], self.nulls[q] = s[top], i[top], z[top]


def rescored(p: Postings, impact: np.ndarray, bounds: np.ndarray, of: list[np.ndarray], id: np.ndarray, null: np.ndarray, best: Best, step: int = 64) -> int:
    """Feeds ``best`` with exact scores in descending order of bounds, until the next bound is below the worst kept score.

    Returns how many (query, text) pairs were scored.
    """
    done = 0
    for q, terms in enumerate(of):
        b = bounds[:, q]
        worst = best.score[q, -1]
        near = np.flatnonzero((b > worst) | ((b == worst) & (b > 0) & (id <= best.id[q, -1])))
        near = near[np.argsort(-b[near], kind="stable")]
        for start in range(0, len(near), step):
            if b[near[start]] < best.score[q, -1]:
                break
            part = near[start : start + step]
            want = part[:, None] * p.width + terms
            at = np.minimum(np.searchsorted(p.key, want), max(len(p.key) - 1, 0))
            exact = np.where(p.key[at] == want, impact[at], 0).sum(axis=1)
            some = exact > 0
            best.add(q, exact[some], id[part][some], null[part][some])
            done += len(part)
    return done


def sketched(p: Postings, impact: np.ndarray, coordinate: np.ndarray, size: int) -> np.ndarray:
    """Per text ``size`` numbers: the largest impact of the terms that hash to each coordinate."""
    out = np.zeros((len(p.n), size))
    np.maximum.at(out, (p.text, coordinate[p.term]), impact)
    return out


def search(docs: DataFrame, queries: DataFrame, *, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text",
           k: int = 10, size: int = 1024, most_bytes: int = 4 << 20) -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` highest-scoring documents with a score above 0; equal scores by ascending id.

    One pass counts documents, terms and the documents of each query term; the next scores every whole text. There each
    text's impacts fold into ``size`` maxima by a hash of the term. A product with the queries' coordinates gives every
    (text, query) pair an upper bound at once; exact scores are then taken in descending order of the bounds until the next
    bound is below the k-th score that the task has for the query. So no document is left out, whatever ``size`` is.
    A task hands on k rows per query, of which two rounds of ranking (first in hashed parts, then per query) leave the k best.
    Texts are never shuffled. Queries are broadcast in rounds of ``most_bytes`` of text, each against all documents.

    Null and empty texts have no terms; a query without terms has no rows; query rows that share an id (null too) are one
    query; documents that repeat an id are ranked each by itself, and a null document id ranks behind the others; an
    empty table gives an empty result; very long texts are read whole, in slices of 2 MB or one text; other columns play no part.
    """
    d = inner_names(docs, {"id": id, "t": text})
    d = d.select(F.col("id").cast("long").alias("id"), F.col("t").cast("string").alias("t"))
    asked = inner_names(queries, {"id": query_id, "t": query_text})
    kind = asked.schema["id"].dataType.simpleString()
    asked = asked.select("id", F.col("t").cast("string").alias("t"))
    found = d.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id long, score long")
    for batch in batches(asked, most_bytes):
        if batch.of:
            found = found.unionByName(_ranked(_best(d, batch, k, size), batch, kind, k))
    return found


def _best(d: DataFrame, batch: Batch, k: int, size: int) -> DataFrame:
    n, total, df = counted(d, batch)
    weight = weights(n, df)
    coordinate = (hashes(list(batch.terms)) % np.uint64(size)).astype(np.int64)
    lookups = np.zeros((size, len(batch.of)))  # how many of a query's terms look at a coordinate
    for q, terms in enumerate(batch.of):
        np.add.at(lookups[:, q], coordinate[terms], 1)
    sent = d.sparkSession.sparkContext.broadcast((batch.terms, batch.of, weight, coordinate, lookups))

    def run(rows):
        terms, of, weight, coordinate, lookups = sent.value
        best = Best(len(of), k)
        for b in rows:
            for part in slices(iter([b]), "t"):
                p = postings(part.column("t"), terms)
                if not len(p.key):
                    continue
                id = part.column("id")
                null = np.asarray(id.is_null())
                id = id.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
                impact = impacts(p, weight, n, total)
                bounds = sketched(p, impact, coordinate, size) @ lookups  # whole numbers below 2 ** 53: exact
                rescored(p, impact, bounds, of, id, null, best)
        q, r = np.nonzero(best.score > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(best.id[q, r], pa.int64(), mask=best.nulls[q, r]), pa.array(best.score[q, r], pa.int64())], names=["q", "id", "score"])

    return in_arrow(d, run, "q int, id long, score long")


def _ranked(best: DataFrame, batch: Batch, kind: str, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    kept = written(best)
    for part in ([F.col("q"), F.pmod(F.xxhash64("id", "score"), F.lit(64))], [F.col("q")]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)
    names = best.sparkSession.createDataFrame(list(enumerate(batch.ids)), f"q int, query_id {kind}")
    return kept.join(F.broadcast(names), "q").select("query_id", "rank", "id", "score")
