"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its site and path are like."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import in_arrow, written
from .labelled import sample_labels, sample_texts
from .logistic import fit, logit
from .texts import ALNUM, NOT_SPACE, raw, slices, sums, words

NAMES = ("repeated", "capital", "symbols", "bare_symbols", "distinct", "word_length")
_ASCII = np.arange(256)
UPPER = (_ASCII >= 65) & (_ASCII <= 90)
LETTER = UPPER | ((_ASCII >= 97) & (_ASCII <= 122))
SYMBOL = NOT_SPACE & ~ALNUM & (_ASCII >= 32) & (_ASCII < 127)


def features(column: pa.Array) -> np.ndarray:
    """Per text: shares of repeated words, capitals, symbols and words of symbols alone, distinct words, word length.

    Each share is drawn a little to what is usual, so that very short texts aren't extreme.
    """
    o, d = raw(column)
    got = words(column, NOT_SPACE)
    codes, _ = got.coded()
    n = np.diff(got.first).astype(float)
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[got.first[:-1][n > 0]] = 0
    lengths = np.diff(got.array.buffers()[1] and np.frombuffer(got.array.buffers()[1], np.int64)[: len(codes) + 1]) if len(codes) else np.zeros(0)
    text = np.repeat(np.arange(len(n)), np.diff(got.first))
    known = len(codes) and np.bincount(np.unique(text * (codes.max() + 1) + codes.astype(np.int64)) // (codes.max() + 1), minlength=len(n))
    real = np.diff(words(column, ALNUM).first)
    letters, upper, symbols = (sums(t[d].astype(np.float64), o) for t in (LETTER, UPPER, SYMBOL))
    bytes_ = np.diff(o).astype(float)
    return np.column_stack([
        sums(same, got.first) / (n + 8),
        (upper + 1) / (letters + 20),
        (symbols + 1) / (bytes_ + 30),
        np.clip(n - real, 0, None) / (n + 8),
        (known + 8) / (n + 8) * np.log1p(n),
        sums(lengths, got.first) / np.maximum(n, 1),
    ])


def train(docs: DataFrame, labels: DataFrame, keep=None, *, target: str = "quality", most: int = 3000, most_bytes: int = 16384, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights of the document classifier, from at most ``most`` labelled documents per class of at most ``most_bytes`` bytes.

    ``keep`` tells from the id which labels may be used; all by default. Without labels the evidence is nil.
    """
    sample = sample_texts(docs, sample_labels(labels, id, target, most, keep or (lambda i: F.lit(True))), id, text, most_bytes)

    def run(batches):
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([*map(pa.array, features(batch.column("t")).T), batch.column("y")], [*NAMES, "y"])

    t = in_arrow(sample.select("t", "y"), run, ", ".join(f"{c} double" for c in NAMES) + ", y int").toPandas()
    x, y = t[list(NAMES)].to_numpy(), t["y"].to_numpy()
    w = fit(x, y)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    w[-1] += np.log(share / (1 - share)) * (len(y) > 0)
    return w


def evidence(weights: np.ndarray, text: Column) -> Column:
    """Log odds of good quality from the text alone; null counts as empty."""

    @arrow_udf("double")
    def of(t: pa.Array) -> pa.Array:
        parts = [logit(weights, features(b.column("t"))) for b in slices([pa.RecordBatch.from_arrays([t], ["t"])], "t")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(text)


def site_table(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, path_sum, path_n, host_mean, strength) from (host, path, p) rows, and the global mean.

    A host's mean is drawn to the global one and a path's to its host's, the more the fewer
    documents they have. How strongly follows from how much hosts (paths) differ beyond what chance
    makes them differ: the beta prior of that variance. Paths are summed before hosts and hosts before the
    whole, so a hot host is a row per task.
    """
    path = written(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    host = path.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    m, k0 = _prior(host.select(F.col("hs").alias("s"), F.col("hn").alias("n")))
    host = host.select(F.col("host").alias("host_"), ((F.lit(k0 * m) + F.col("hs")) / (F.lit(k0) + F.col("hn"))).alias("host_mean"))
    joined = path.join(host, F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    _, k1 = _prior(path)
    return written(joined.withColumn("strength", F.lit(float(k1)))), m


def _prior(groups: DataFrame) -> tuple[float, float]:
    """Mean and strength of the beta prior of groups with sums ``s`` over ``n`` rows, by moments."""
    r = groups.agg(F.sum("s"), F.sum("n"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum(F.lit(1.0)), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    s, n, ss, g, nn = (float(x or 0) for x in r)
    if n == 0:
        return 0.5, 1.0
    m = min(max(s / n, 1e-3), 1 - 1e-3)
    chance = (g - 1) * m * (1 - m)
    spread = (ss - m * m * n - chance) / max(n - nn / n, 1e-9) if g > 1 else 0.0
    return m, float(np.clip(m * (1 - m) / spread - 1, 2.0, 1e4)) if spread > 0 else 1e4


def score(docs: DataFrame, weights: np.ndarray, *, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """(row, evidence, site, posterior): each row of ``docs`` as a struct, with the posterior of good quality.

    The posterior's log odds are those of the text, moved by how far the site's odds lie
    from the global odds; a site's mean leaves out the document itself. Empty and null texts have
    the evidence of no words; null hosts and paths are sites of their own; repeated rows count
    each. An empty table gives an empty result. Texts aren't shuffled unless the table of sites is too
    large for Spark to broadcast, where its skew handling splits a hot site.
    """
    field = {c.lower(): c for c in docs.columns}
    get = lambda c: F.col(f"`{field[c.lower()]}`") if c.lower() in field else F.lit(None)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), get(host).cast("string").alias("host"),
        get(path).cast("string").alias("path"), evidence(weights, get(text).cast("string")).alias("evidence"),
    ).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    sites, m = site_table(rows.select("host", "path", "p"))
    named = sites.withColumnsRenamed({"host": "host_", "path": "path_"})
    got = rows.join(named, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")), "left")
    mean = (F.col("strength") * F.col("host_mean") + F.col("s") - F.col("p")) / (F.col("strength") + F.col("n") - 1)
    mean = F.greatest(F.least(mean, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.col("evidence") + F.log(mean / (1 - mean)) - F.lit(float(np.log(m / (1 - m))))
    return got.select("row", "host", "path", "evidence", mean.alias("site"), (1 / (1 + F.exp(-odds))).alias("posterior"))


def good(docs: DataFrame, weights: np.ndarray, *, threshold: float = 0.5, **cols) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches the threshold, with their own columns.

    Null and empty texts are judged by their site and the prior; repeated rows share their fate; an empty table stays
    empty; very long texts are read whole; columns of any name pass through.
    """
    return score(docs, weights, **cols).where(F.col("posterior") >= threshold).select("row.*")

