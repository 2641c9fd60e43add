"""Ordered per-key scans (lag, lead, running index, running sums) that stay balanced under skew.

A plain window puts every row of a key into one task. That is the right plan for
ordinary keys, but a key holding a large share of all rows would make one task do
most of the work. ``ordered_scan`` therefore counts the keys first. Keys up to
``hot_rows`` rows use a plain window. Larger keys are range-partitioned on
(key, order), so one key spans many tasks; each piece is scanned on its own and
the pieces are stitched with one small summary row per piece. Both ways give the
same rows. With no key columns the whole table is the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS
from ..session import cut_lineage


def _order(order: Sequence[str]) -> list[Column]:
    """Ascending sort columns; a leading minus means descending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def _plain(df, keys, order, lag, lead, index, moments, running) -> DataFrame:
    part = Window.partitionBy(*keys) if keys else Window.partitionBy()
    w = part.orderBy(*_order(order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {name: F.lag(src).over(w) for name, src in lag.items()}
    out.update({name: F.lead(src).over(w) for name, src in lead.items()})
    if index:
        out[index] = F.row_number().over(w).cast("bigint")
    for name, src in moments.items():
        out[f"{name}_mean"] = F.avg(src).over(before)
        out[f"{name}_std"] = F.stddev_pop(src).over(before)
    for name, src in running.items():
        out[name] = F.sum(src).over(upto)
    return df.withColumns(out)


def _pieces(df, keys, order, lag, lead, index, moments, running, hot_rows, total) -> DataFrame:
    """The split form: range pieces, per-piece scan, stitched by per-piece summaries."""
    # a small hot_rows asks for the split form, not for a task per few rows
    most = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // DEFAULTS.hot_rows) * 2)
    n = max(2, min(-(-total // max(hot_rows, 1)) * 2, most))
    cut = df.repartitionByRange(int(n), *([F.col(k) for k in keys] + _order(order)))
    cut = cut_lineage(cut.withColumn("_piece", F.spark_partition_id()))
    group = [*keys, "_piece"]
    w = Window.partitionBy(*group).orderBy(*_order(order))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    scanned = {"_rn": F.row_number().over(w).cast("bigint")}
    scanned.update({f"_lag_{n_}": F.lag(s).over(w) for n_, s in lag.items()})
    scanned.update({f"_lead_{n_}": F.lead(s).over(w) for n_, s in lead.items()})
    scanned["_last"] = F.lead(F.lit(False), 1, True).over(w)
    for m, src in moments.items():
        d = F.col(src) - F.col(f"_shift_{m}")
        scanned[f"_s1_{m}"] = F.sum(d).over(upto)
        scanned[f"_s2_{m}"] = F.sum(d * d).over(upto)
    for r, src in running.items():
        scanned[f"_run_{r}"] = F.sum(src).over(upto)
    rows = cut.withColumns(scanned)

    aggs = [F.max("_rn").alias("_n")]
    for n_, s in lag.items():
        aggs.append(F.max(F.when(F.col("_last"), F.col(s))).alias(f"_end_{n_}"))
    for n_, s in lead.items():
        aggs.append(F.max(F.when(F.col("_rn") == 1, F.col(s))).alias(f"_begin_{n_}"))
    for m in moments:
        aggs += [F.max(F.when(F.col("_last"), F.col(f"_s{i}_{m}"))).alias(f"_t{i}_{m}") for i in (1, 2)]
    for r in running:
        aggs.append(F.max(F.when(F.col("_last"), F.col(f"_run_{r}"))).alias(f"_tr_{r}"))
    piece = rows.groupBy(*group).agg(*aggs)

    pw = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_piece")
    earlier = pw.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_off": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
    carry.update({f"_prev_{n_}": F.lag(f"_end_{n_}").over(pw) for n_ in lag})
    carry.update({f"_next_{n_}": F.lead(f"_begin_{n_}").over(pw) for n_ in lead})
    for m in moments:
        for i in (1, 2):
            carry[f"_o{i}_{m}"] = F.coalesce(F.sum(f"_t{i}_{m}").over(earlier), F.lit(0.0))
    for r in running:
        carry[f"_or_{r}"] = F.sum(f"_tr_{r}").over(earlier)
    piece = piece.withColumns(carry).select(*[F.col(k).alias(f"_g_{k}") for k in group], *carry)

    match = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in group]
    joined = rows.join(piece, match)
    out = {}
    for n_ in lag:
        out[n_] = F.when(F.col("_rn") == 1, F.col(f"_prev_{n_}")).otherwise(F.col(f"_lag_{n_}"))
    for n_ in lead:
        out[n_] = F.when(F.col("_last"), F.col(f"_next_{n_}")).otherwise(F.col(f"_lead_{n_}"))
    if index:
        out[index] = F.col("_off") + F.col("_rn")
    for m, src in moments.items():
        d = F.col(src) - F.col(f"_shift_{m}")
        count = F.col("_off") + F.col("_rn") - 1
        s1 = F.col(f"_o1_{m}") + F.col(f"_s1_{m}") - d
        s2 = F.col(f"_o2_{m}") + F.col(f"_s2_{m}") - d * d
        out[f"{m}_mean"] = F.when(count > 0, F.col(f"_shift_{m}") + s1 / count)
        out[f"{m}_std"] = F.when(count > 0, F.sqrt(F.greatest((s2 - s1 * s1 / count) / count, F.lit(0.0))))
    for r in running:
        out[r] = F.col(f"_run_{r}") + F.coalesce(F.col(f"_or_{r}"), F.lit(0))
    extra = [*lag, *lead, *([index] if index else [])]
    extra += [f"{m}_{x}" for m in moments for x in ("mean", "std")] + list(running)
    base = [c for c in df.columns if not c.startswith("_shift_")]
    return joined.withColumns(out).select(*base, *extra)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    index: str | None = None,
    moments: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    hot_rows: int | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """Add ordered-scan columns to ``df``.

    ``order`` must be a total order inside each key. ``lag``/``lead`` map an output
    name to the column read from the previous/next row, ``index`` names a 1-based
    running index, ``moments`` maps a name to a column whose mean and population
    deviation over strictly earlier rows become ``<name>_mean``/``<name>_std``, and
    ``running`` maps an output to a column summed up to and including the row.
    Keys aren't counted if the caller knows that ``df`` has up to ``most_rows`` rows, no more than ``hot_rows``.
    """
    lag, lead, moments, running = dict(lag or {}), dict(lead or {}), dict(moments or {}), dict(running or {})
    hot_rows = DEFAULTS.hot_rows if hot_rows is None else hot_rows
    args = (list(keys), list(order), lag, lead, index, moments, running)
    shifts = [F.min(src).alias(f"_shift_{m}") for m, src in moments.items()]

    if not keys:
        total = df.count()
        if total <= hot_rows:
            return _plain(df, *args)
        if shifts:
            first = df.agg(*shifts).first().asDict()
            df = df.withColumns({k: F.lit(v) for k, v in first.items()})
        return _pieces(df, *args, hot_rows, total)

    if most_rows is not None and most_rows <= hot_rows:
        return _plain(df, *args)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *shifts)
    hot = sizes.where(F.col("_size") > hot_rows)
    total = hot.agg(F.sum("_size")).first()[0]
    if not total:
        return _plain(df, *args)
    hot = cut_lineage(hot)
    same = [df[k].eqNullSafe(hot[k]) for k in keys]
    cold_rows = df.join(hot, same, "left_anti")
    hot_part = hot.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_shift_{m}" for m in moments])
    match = [df[k].eqNullSafe(hot_part[f"_k_{k}"]) for k in keys]
    hot_rows_df = df.join(hot_part, match).drop(*[f"_k_{k}" for k in keys])
    cold = _plain(cold_rows, *args)
    return cold.unionByName(_pieces(hot_rows_df, *args, hot_rows, int(total)))


def exact_quantile(df: DataFrame, value: str, q: float, hot_rows: int | None = None) -> float | None:
    """Linear-interpolated quantile, exact at any size.

    Up to ``hot_rows`` rows the built-in ``percentile`` is used. Beyond that an
    approximate quantile only narrows the range; the exact rank is then found from
    per-value counts inside that range, scanned in pieces.
    """
    hot_rows = DEFAULTS.hot_rows if hot_rows is None else hot_rows
    values = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        return None
    if n <= hot_rows:
        return values.agg(F.percentile("v", F.lit(q))).first()[0]
    pos = (n - 1) * q
    lo, hi = int(pos), min(int(pos) + 1, n - 1)
    eps = 1e-4
    bounds = [max(q - 3 * eps, 0.0), min(q + 3 * eps, 1.0)]
    a, b = values.agg(F.percentile_approx("v", F.array(*map(F.lit, bounds)), int(1 / eps))).first()[0]
    below, upto = values.agg(
        F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)
    ).first()
    if below > lo:
        a, below = float("-inf"), 0
    if upto <= hi:
        b = float("inf")
    inside = values.where((F.col("v") >= a) & (F.col("v") <= b)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranked = ordered_scan(inside, [], ["v"], running={"cum": "c"}, hot_rows=hot_rows)
    at = ranked.agg(
        F.min(F.when(F.col("cum") + below > lo, F.col("v"))), F.min(F.when(F.col("cum") + below > hi, F.col("v")))
    ).first()
    return at[0] + (at[1] - at[0]) * (pos - lo)


def group_median(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, hot_rows=None) -> DataFrame:
    """Exact median per key from a running index, so no group has to fit in one aggregation buffer."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, tie)
    ranked = ordered_scan(rows, keys, [value, tie], index="_i", hot_rows=hot_rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    mid = ranked.join(sizes, list(keys)).where(
        (F.col("_i") == F.floor((F.col("_c") + 1) / 2)) | (F.col("_i") == F.floor(F.col("_c") / 2) + 1)
    )
    return mid.groupBy(*keys).agg(F.avg(value).alias(out))
