"""Global order without a single-task window.

Rows are spread over range buckets of the order column; windows run per bucket and a
table with one row per bucket carries counts and edge rows across bucket borders. A
value that fills several buckets on its own is split further by the tie-break key.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import col


def sort_number(df: DataFrame, name: str) -> Column:
    """The column as a double or long with the same order."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp"))
    return col(name)


def cut_index(value: Column, cuts: Sequence[float]) -> Column:
    """2 * (cuts below value) + (value equals a cut): every cut value has its own bucket.

    A first look at every ``step``-th cut finds the block of cuts to count in, so a row meets
    about twice the root of their number.
    """
    cuts = list(cuts)
    if not cuts:
        return F.lit(0).cast("long")
    step = max(1, math.isqrt(len(cuts)))
    every = F.array(*map(F.lit, cuts))
    block = F.size(F.filter(F.array(*map(F.lit, cuts[::step])), lambda c: c < value))
    start = F.greatest(F.lit(0), block - 1) * step
    below = start + F.size(F.filter(F.slice(every, start + 1, step), lambda c: c < value))
    hit = F.coalesce(F.get(every, below) == value, F.lit(False))
    return (2 * below + hit.cast("int")).cast("long")


def range_buckets(df: DataFrame, order: str, key: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: ascending with ``(order, key)``; no bucket holds much more than its share.

    ``order`` and ``key`` must be numeric, date or timestamp columns without nulls.
    """
    k = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / k for i in range(1, k)]
    o, t = sort_number(df, order), sort_number(df, key)
    raw = df.agg(F.percentile_approx(o, probs, 10 * k)).first()[0] or []
    cuts = sorted(set(raw))
    hot = sorted(v for v, times in Counter(raw).items() if times > 1)
    bucket = cut_index(o, cuts)
    if hot:
        fine = df.where(o.isin(hot)).agg(F.percentile_approx(t, probs, 10 * k)).first()[0] or []
        tie_cuts = sorted(set(fine))
        within = F.when(o.isin(hot), cut_index(t, tie_cuts)).otherwise(F.lit(0).cast("long"))
        bucket = bucket * (2 * k + 2) + within
    return df.withColumn("_bucket", bucket)


def _edges(b: DataFrame, order: str, key: str, part: list[str], values: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """One row per bucket (and partition): rows and sums before it, and the last row before it."""
    pos = F.struct(col(order), col(key))
    row = F.struct(*[col(v) for v in values]) if values else F.struct(F.lit(None).alias("_none"))
    per = b.groupBy("_bucket", *part).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(row, pos).alias("_last"),
        *[F.sum(col(s)).alias(f"_sum_{s}") for s in sums],
    )
    # bounded: at most one row per range bucket in each window partition
    w = Window.partitionBy(*part).orderBy("_bucket") if part else Window.orderBy("_bucket")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        F.col("_bucket").alias("_eb"),
        *[F.col(p).alias(f"_e{p}") for p in part],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.lag("_last").over(w).alias("_last_before"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_sum_before_{s}") for s in sums],
    )


def with_order(
    df: DataFrame,
    order: str,
    key: str,
    lag: Sequence[str] = (),
    running_sum: Sequence[str] = (),
    position: str | None = "_pos",
    buckets: int | None = None,
    partition: Sequence[str] = (),
) -> DataFrame:
    """Add a 1-based position, ``prev_<c>`` and ``run_<c>`` in ``(order, key)`` order.

    With ``partition`` the order restarts per group, but groups are still spread over the
    range buckets, so a group holding much of the table is not sorted by one task.
    """
    part = [f"_p{i}" for i in range(len(partition))]
    b = range_buckets(df, order, key, buckets)
    for p, c in zip(part, partition):
        b = b.withColumn(p, col(c))
    edges = _edges(b, order, key, part, lag, running_sum)
    w = Window.partitionBy("_bucket", *part).orderBy(col(order), col(key))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.withColumn("_rn", F.row_number().over(w).cast("long"))
    for c in lag:
        out = out.withColumn(f"_lag_{c}", F.lag(F.struct(col(c).alias("v"))).over(w))
    for c in running_sum:
        out = out.withColumn(f"_run_{c}", F.sum(col(c)).over(upto))
    on = F.col("_bucket") == F.col("_eb")
    for p in part:
        on = on & F.col(p).eqNullSafe(F.col(f"_e{p}"))
    # without partitions the edge table has one row per bucket, a number set above
    out = out.join(edges if part else F.broadcast(edges), on, "left")
    final = [col(c) for c in df.columns]
    if position:
        final.append((F.col("_rn") + F.col("_rows_before")).alias(position))
    for c in lag:
        carried = F.when(F.col("_rn") == 1, col("_last_before")[c]).otherwise(F.col(f"_lag_{c}")["v"])
        final.append(carried.alias(f"prev_{c}"))
    for c in running_sum:
        final.append((F.coalesce(F.col(f"_run_{c}"), F.lit(0)) + F.col(f"_sum_before_{c}")).alias(f"run_{c}"))
    return out.select(*final)
