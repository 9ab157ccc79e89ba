"""Ordered analyses: halves, steps, gaps and runs, all over a bucketed global order."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import with_order
from plumbline.functions.stats import scalar_row
from plumbline.model import col, kind_of


def row_numbers(df: DataFrame, partition: Sequence[str], order: str, tie: Sequence[str], descending: bool = True) -> DataFrame:
    by = F.desc(order) if descending else F.asc(order)
    w = Window.partitionBy(*[col(p) for p in partition]).orderBy(by, *[col(t) for t in tie])
    return df.withColumn("row_number", F.row_number().over(w))


def top_per_group(df: DataFrame, partition: Sequence[str], order: str, tie: Sequence[str], n: int, descending: bool = True) -> DataFrame:
    """The first n rows per group. Spark cuts each map partition to n rows per group before the shuffle."""
    return row_numbers(df, partition, order, tie, descending).where(F.col("row_number") <= n)


def split_half(df: DataFrame, value: str, order: str, key: str) -> DataFrame:
    """Means of odd and even rows in a stated order, and a 0-1 stability score."""
    rank = lambda c: col(c) if kind_of(df.schema[c].dataType) in ("number", "date") else F.xxhash64(col(c))  # noqa: E731  ranges need numbers
    d = df.select(col(value).cast("double").alias("v"), rank(order).alias("o"), rank(key).alias("k"))
    even = F.pmod(F.col("_pos"), F.lit(2)) == 0
    s = with_order(d, "o", "k").agg(F.avg(F.when(even, F.col("v"))).alias("mean_even"), F.avg(F.when(~even, F.col("v"))).alias("mean_odd"))
    diff = F.abs(F.col("mean_even") - F.col("mean_odd")) / (F.abs("mean_even") + F.abs("mean_odd") + 1e-9)
    return s.withColumn("stability", 1 - F.least(F.lit(1.0), diff * 2))


def step_anomalies(df: DataFrame, value: str, order: str, key: str, z: float = 3.0) -> DataFrame:
    """Rows whose absolute change from the previous value is z or more sigmas above the mean change."""
    d = df.where(col(value).isNotNull()).select(col(key).alias("key"), col(order).alias("ord"), col(value).cast("double").alias("value"))
    steps = with_order(d, "ord", "key", lag=["value"], position=None).where(F.col("prev_value").isNotNull())
    steps = steps.withColumn("step", F.abs(F.col("value") - F.col("prev_value")))
    s = scalar_row(steps, mean=F.avg("step"), sd=F.stddev_pop("step"))
    score = F.try_divide(F.col("step") - s["mean"], s["sd"])
    return (
        steps.withColumn("z", score)
        .where(F.col("z") >= z)
        .select("key", "value", "prev_value", "z", F.when(F.col("z") >= 4, "high").otherwise("medium").alias("severity"))
    )


def date_gaps(df: DataFrame, date: str, key: str, z: float = 2.5) -> DataFrame:
    """Unusually long gaps between consecutive rows in date order (in days)."""
    d = df.where(col(date).isNotNull()).select(col(key).alias("key"), col(date).alias("at"))
    steps = with_order(d, "at", "key", lag=["at"], position=None).where(F.col("prev_at").isNotNull())
    micros = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("prev_at").cast("timestamp"))
    steps = steps.withColumn("gap_days", micros / 86_400_000_000.0)
    s = scalar_row(steps, mean=F.avg("gap_days"), sd=F.stddev_pop("gap_days"))
    score = F.try_divide(F.col("gap_days") - s["mean"], s["sd"])
    return (
        steps.withColumn("z", score)
        .where(F.col("z") > z)
        .select("key", "gap_days", "z", F.when(F.col("z") >= 4, "high").otherwise("medium").alias("severity"))
    )


def missing_runs(df: DataFrame, column: str, order: str, key: str, minimum: int = 3) -> DataFrame:
    """Runs of consecutive blank values: position minus running blank count is constant within a run."""
    blank = col(column).isNull() | (F.trim(col(column).cast("string")) == "")
    d = df.select(col(order).alias("ord"), col(key).alias("key"), blank.cast("long").alias("blank"))
    p = with_order(d, "ord", "key", running_sum=["blank"]).where(F.col("blank") == 1)
    runs = p.groupBy((F.col("_pos") - F.col("run_blank")).alias("_g")).agg(
        F.min("_pos").alias("first_row"), F.count(F.lit(1)).alias("length")
    )
    sev = F.when(F.col("length") >= 10, "high").otherwise("medium")
    return runs.where(F.col("length") >= minimum).select(F.lit(column).alias("column"), "first_row", "length", sev.alias("severity"))


def category_shift(df: DataFrame, column: str, order: str, key: str, threshold: float = 0.25) -> DataFrame:
    """Categories whose share moves more than the threshold between first and second half."""
    k = F.coalesce(col(column).cast("string"), F.lit(""))
    d = df.select(col(order).alias("ord"), col(key).alias("key"), k.alias("category"))
    n = d.agg(F.count(F.lit(1))).scalar()
    half = F.floor(n / 2)
    p = with_order(d, "ord", "key")
    g = p.groupBy("category").agg(
        F.count_if(F.col("_pos") <= half).alias("n_first"), F.count_if(F.col("_pos") > half).alias("n_second")
    )
    s1, s2 = F.try_divide(F.col("n_first").cast("double"), half), F.try_divide(F.col("n_second").cast("double"), half)
    g = g.withColumns({"share_first": s1, "share_second": s2})
    shift = F.abs(F.col("share_second") - F.col("share_first"))
    big = (F.col("share_first") > 0.05) | (F.col("share_second") > 0.05)
    return g.where((shift > threshold) & big).withColumn("severity", F.when(shift > 0.4, "high").otherwise("medium"))


def analytic_columns(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The ranking and analytic functions over one partitioned, ordered window."""
    w = Window.partitionBy(*[col(p) for p in partition]).orderBy(*[col(o) for o in order])
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = w.rowsBetween(-2, 2)
    v = col(value)
    return df.withColumns(
        {
            "rn": F.row_number().over(w), "rk": F.rank().over(w), "drk": F.dense_rank().over(w), "quartile": F.ntile(4).over(w),
            "prev_v": F.lag(v).over(w), "next_v": F.lead(v).over(w), "pr": F.percent_rank().over(w), "cd": F.cume_dist().over(w),
            "first_v": F.first(v).over(upto), "last_v": F.last(v).over(upto), "second_v": F.nth_value(v, 2).over(upto),
            "running": F.sum(v).over(upto), "moving": F.avg(v).over(near),
        }
    )
