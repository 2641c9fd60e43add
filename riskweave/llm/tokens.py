"""Token counts without token ids: pieces are counted once per distinct pre-token and summed by frequency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import in_arrow, inner_names
from .texts import raw, slices

SPACE_MARK = "▁"


class PieceCounter:
    """Pre-tokens of a sentencepiece model, and the number of pieces of each.

    A pre-token is a run of spaces with the run of other characters after it, or the
    spaces at the end. No piece of the vocabulary holds a space mark after another
    character, so no merge reaches over the border between two pre-tokens and their counts
    add up. The constructor checks that of the vocabulary.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("pieces of this vocabulary reach over spaces")
        if self.model.encode("  ", out_type=str) != self.model.encode(f" {SPACE_MARK}", out_type=str) or not self.model.encode(" a"):
            raise ValueError("this vocabulary doesn't keep spaces")

    def split(self, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(first, pre-tokens) per text; the first space of each, there or implied, is left out."""
        o, d = raw(column)
        if SPACE_MARK.encode() in d.tobytes():
            column = pa.compute.replace_substring(column.cast(pa.string()), SPACE_MARK, " ")
            o, d = raw(column)
        if not len(d):
            return np.zeros(len(o), np.int64), pa.array([], pa.large_binary())
        space = d == 32
        begins = np.zeros(len(d) + 1, bool)
        begins[o] = True
        other_before = np.empty(len(d), bool)
        other_before[0] = False
        other_before[1:] = ~space[:-1]
        # A pre-token begins where a text does (its implied space) and at each space after another character (that space).
        cut = begins[:-1] | (space & other_before)
        drop = space & other_before & ~begins[:-1]
        starts = np.flatnonzero(cut)
        keep = ~drop
        at = np.zeros(len(starts) + 1, np.int64)
        at[1:] = np.cumsum(np.add.reduceat(keep.astype(np.int64), starts))
        data = np.ascontiguousarray(d[keep])
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)])
        return np.searchsorted(starts, o).astype(np.int64), array

    def pieces(self, distinct: list[bytes]) -> np.ndarray:
        """Pieces of each pre-token. One without any character stands for a single space, which is one piece."""
        got = self.model.encode([w.decode() for w in distinct], num_threads=1)
        return np.fromiter((len(x) or 1 for x in got), np.int64, len(distinct))


def count_tokens(docs: DataFrame, counter: Callable[[], PieceCounter], *, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    Each block of rows is split into pre-tokens and reduced to its distinct ones; their
    pieces are counted once, joined to the occurrences by number, and summed per
    document. Nothing is shuffled; a task holds 2 MB of text or one text at a time. Null
    and empty texts have no tokens; repeated rows are counted as often as they come; an empty table gives an
    empty result; other columns play no part, whatever their names.
    """
    rows = inner_names(docs, {"id": id, "t": text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()
        for batch in slices(batches, "t"):
            o, _ = raw(batch.column("t"))
            first, array = own.split(batch.column("t"))
            coded = array.dictionary_encode()
            each = own.pieces(coded.dictionary.to_pylist())
            total = np.zeros(len(array) + 1, np.int64)
            np.cumsum(each[coded.indices.to_numpy()], out=total[1:])
            n = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(o)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
