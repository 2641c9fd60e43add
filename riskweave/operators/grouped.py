"""Groups of bounded size worked through inside tasks, one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Links from which a part of a graph is too large for one task.
MOST_LINKS = 200_000


def by_group(df: DataFrame, schema: str, names: list[str], run: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """``run`` over all rows of each ``g`` (without it), giving rows of texts, or lists of texts; a group's rows lie in one task, one after another."""
    kept = [c for c in df.columns if c != "g"]
    kinds = [pa.list_(pa.string()) if f.endswith("array<string>") else pa.string() for f in schema.split(", ")]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            for g, *row in zip(b.column("g").to_pylist(), *(b.column(c).to_pylist() for c in kept)):
                if g != now and rows:
                    for row_ in run(rows):
                        out.append(row_)
                        if len(out) > 5000:
                            yield told(out)
                            out = []
                    rows = []
                now = g
                rows.append(tuple(row))
        if rows:
            for row_ in run(rows):
                out.append(row_)
                if len(out) > 5000:
                    yield told(out)
                    out = []
        if out:
            yield told(out)

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(over, schema)
