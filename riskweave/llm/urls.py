"""URL filters: a trie over reversed host labels and path segments, broadcast, in which the longest match decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, inner_names, written

ALLOW, BLOCK = "allow", "block"
RULES = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


class Trie:
    """Entries by reversed host labels, then by whole path segments, then by what their path has after its last slash.

    ``steps`` leads from (node, label) to a node; host labels and path segments can't be mistaken for
    one another, as segments are kept with a slash in front. ``ends`` holds, per node, the entries that end there:
    their broken last segment (often empty), verdict and text.
    """

    def __init__(self, entries: Sequence[tuple[str, str, str]]):
        self.steps: dict[tuple[int, str], int] = {}
        self.ends: dict[int, dict[str, tuple[str, str]]] = {}
        for verdict, host, path in entries:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict is allow or block, not {verdict!r}")
            if not host:
                raise ValueError("an entry needs a host")
            *whole, last = path.split("/")
            at = 0
            for step in [*reversed(host.lower().split(".")), *[f"/{s}" for s in whole]]:
                at = self.steps.setdefault((at, step), len(self.steps) + 1)
            here = self.ends.setdefault(at, {})
            if last not in here or here[last][0] != BLOCK:  # the same entry in both lists blocks
                here[last] = (verdict, host.lower() + path)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, text) of the entry with the longest text that fits, the one with more host labels first; None if none fits."""
        best, size = None, -1
        pieces = path.split("/")
        node = 0
        for label in reversed(host.split(".")):
            node = self.steps.get((node, label))
            if node is None:
                break
            at: int | None = node
            for i, piece in enumerate(pieces):
                # ``piece`` is cut off here by the entry's end, or else must match as a whole segment
                for last, found in self.ends.get(at, {}).items():
                    if len(found[1]) >= size and piece.startswith(last):
                        best, size = found, len(found[1])
                if i + 1 == len(pieces):
                    break
                at = self.steps.get((at, f"/{piece}"))
                if at is None:
                    break
        return best


def judged(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], *, id: str = "page_id", url: str = "url",
           default: str = ALLOW, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per page: id, host, path, rule and verdict (``rule``'s, else ``default``).

    ``rules`` are (verdict, host, path) entries, verdict ``allow`` or ``block``. An entry fits its host and all
    subdomains if the page's path starts with the entry's path (as text; an entry with a path doesn't fit an
    empty path). The entry with the longest text wins, among equally long ones that with more host
    labels; an entry in both lists blocks. The trie is broadcast and pages are never shuffled, so a host with most of the
    pages costs nothing extra. Entries beyond ``most_bytes`` of text are dealt over several tries which are broadcast one after
    another, the better match being kept on the narrow (id, host, path) rows, so every task's memory is bounded.

    Null or relative urls have an empty host and path and get the default; hosts are taken as written (a port or
    user name belongs to them); repeated pages and null ids each keep their row; an empty table, or no entries, is
    fine; very long urls are cut nowhere; other columns play no part, whatever their names.
    """
    if default not in (ALLOW, BLOCK):
        raise ValueError(f"default is allow or block, not {default!r}")
    spark = pages.sparkSession
    rows = inner_names(pages, {"id": id, "u": url})
    rows = rows.select("id", host_of(F.col("u").cast("string")).alias("host"), path_of(F.col("u").cast("string")).alias("path"))
    rows = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    for n, entries in enumerate(_dealt(rules, most_bytes)):
        rows = _matched(written(rows) if n else rows, spark.sparkContext.broadcast(Trie(entries)))
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _dealt(rules, most_bytes: int) -> Iterator[list[tuple[str, str, str]]]:
    """The entries in lists of about ``most_bytes`` of text at most."""
    if not isinstance(rules, DataFrame):
        if rules:
            yield list(rules)
        return
    kept = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    size = kept.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0]
    if size is None:
        return
    parts = -(-(size + 1) // most_bytes)
    for part in range(parts):
        here = kept.where(F.pmod(F.xxhash64("host", "path"), F.lit(parts)) == part)
        yield [tuple(r) for r in here.collect()]


def _matched(rows: DataFrame, trie) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in batches:
            cols = {n: b.column(n) for n in ("host", "path", "rule", "verdict")}
            rule, verdict = cols["rule"].to_pylist(), cols["verdict"].to_pylist()
            for i, (h, p) in enumerate(zip(cols["host"].to_pylist(), cols["path"].to_pylist())):
                found = t.longest(h, p)
                if found and (rule[i] is None or _rank(h, p, found[1]) > _rank(h, p, rule[i])):
                    verdict[i], rule[i] = found
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), cols["host"], cols["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")


def _rank(host: str, path: str, rule: str) -> tuple[int, int]:
    """Length of an entry's text, then its host labels."""
    return len(rule), rule.split("/", 1)[0].count(".")
