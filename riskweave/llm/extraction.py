"""Main text of web pages by boosted trees over DOM elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import in_arrow, inner_names, written


class Trees:
    """Boosted trees as arrays, to score many elements at once."""

    def __init__(self, model):
        self.trees = []
        for weight, tree in zip(model.treeWeights, model.trees):
            rows: list[list[float]] = []

            def add(node) -> int:
                k = len(rows)
                rows.append([0, 0.0, k, k, node.prediction()])
                if node.subtreeDepth() > 0:
                    s = node.split()
                    rows[k][0], rows[k][1] = s.featureIndex(), s.threshold()
                    rows[k][2] = add(node.leftChild())
                    rows[k][3] = add(node.rightChild())
                return k

            add(tree._call_java("rootNode"))
            t = np.array(rows)
            self.trees.append((weight, tree.depth, t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for weight, depth, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = np.where(x[row, feature[at]] <= threshold[at], left[at], right[at])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


class Density:
    """Probabilities where no page can be learned from: long blocks of text with few links are wanted, and headings without links."""

    def probability(self, x: np.ndarray) -> np.ndarray:
        base = len(dom.GROUPS) + dom.BUCKETS
        link, length = (x[:, base + dom.NUMERIC.index(name)] for name in ("link_share", "words_per_block"))
        length = np.where(x[:, dom.GROUPS.index("h")] == 1, np.maximum(length, 20), np.minimum(length, 60))
        return 1 / (1 + np.exp(1.2 - length / 10 + 6 * link))


def train(pages: DataFrame, *, most: int = 400, most_bytes: int = 65536, rounds: int = 15, depth: int = 4, id: str = "page_id", html: str = "html") -> Trees | Density:
    """Fits on at most ``most`` pages of at most ``most_bytes`` bytes that have wanted elements, by hash of their ids.

    No page comes with its main text, so the labels are weak: elements inside ``article`` or
    ``main`` are wanted, those outside and the marked ones inside aren't. Every page is
    seen twice, the second time with its tags and attributes made plain, so that density,
    depth and sibling statistics must decide where markup doesn't tell. Pages without such elements are left out, and others looked
    at in their place until ``most`` are found or all pages were seen. If none has any, the result is ``Density``.
    """
    rows = inner_names(pages, {"id": id, "h": html}).where((F.octet_length("h") <= most_bytes) & F.col("id").isNotNull())
    likely = rows.where(F.col("h").rlike("(?i)<(article|main)"))
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [dom.weak_labels(dom.parse(page)[0]) for page in batch.column("h").to_pylist()]
            yield batch.select(["id"]).filter(pa.array([y is not None and bool(y.any()) for y in labels], pa.bool_()))

    tried = most
    while True:
        first = written(likely.select("id").distinct().orderBy(*order).limit(tried).withColumnRenamed("id", "first"))
        some = likely.join(first, F.col("id") == F.col("first")).select("id", "h")
        chosen = written(in_arrow(some, marked, f"id {rows.schema['id'].dataType.simpleString()}", 200).distinct().orderBy(*order).limit(most).withColumnRenamed("id", "chosen"))
        if chosen.count() >= most or first.count() < tried:
            break
        tried *= 8
    if not chosen.count():
        return Density()
    sample = likely.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for page in batch.column("h").to_pylist():
                nodes, _ = dom.parse(page)
                y = dom.weak_labels(nodes)
                if y is not None:
                    for plain in (False, True):
                        nodes, blocks = dom.parse(page)
                        xs += dom.features(nodes, len(blocks), plain).tolist()
                        ys += y.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["x", "label"])

    data = written(in_arrow(sample, run, "x array<double>, label double", 200)).select(array_to_vector("x").alias("features"), "label").coalesce(1)
    return Trees(GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(data))


def extract(pages: DataFrame, trees: Trees | Density, *, id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(id, url, text, n_chars) per page: the blocks of the elements kept, in page order, one per line.

    Every element of the whole page is scored and the tree decoded so that choices agree along
    each path. Character references are decoded and white space inside a block becomes one
    space. A null or empty page, or one without a kept element, has an empty text; repeated pages are
    extracted as often as they come; an empty table gives an empty result; very long pages are parsed whole, in time in line
    with their size; other columns play no part, whatever their names. No shuffle; a task holds one small batch of pages.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    rows = inner_names(pages, {"id": id, "url": url, "h": html})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            parsed = [dom.parse(page or "") for page in batch.column("h").to_pylist()]
            x = [dom.features(nodes, len(blocks)) for nodes, blocks in parsed]
            p = own.probability(np.concatenate(x)) if x else np.zeros(0)
            texts, at = [], 0
            for nodes, blocks in parsed:
                keep = dom.decode(nodes, p[at : at + len(nodes)])
                at += len(nodes)
                texts.append("\n".join(t for i, t in blocks if keep[i]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, url string, text string, n_chars bigint", 100)
