"""Fingerprint comparison, snapshots and version diffs, forecasts, alert and metric history."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import with_order
from plumbline.model import col, kind_of
from plumbline.plans.profile import _column_rows, value_counts

# What counts as drift between two fingerprints.
MEAN_SIGMAS, NULL_JUMP, CARDINALITY_JUMP = 2.0, 0.2, 0.3


def compare_fingerprints(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drift findings between two fingerprint tables: rows ``(column, kind, measure)``. One row per column each."""
    a = before.select([F.col(c).alias(f"a_{c}") for c in before.columns])
    j = after.join(F.broadcast(a), (F.col("column") == F.col("a_column")) & (F.col("kind") == F.col("a_kind")))
    shift = F.abs(F.col("mean") - F.col("a_mean")) / F.col("a_std")
    fresh = F.array_except("top", "a_top")
    row = lambda k, cond, m: F.when(cond, F.struct(F.lit(k).alias("drift"), m.cast("double").alias("measure")))
    d_null, d_card = F.abs(F.col("null_rate") - F.col("a_null_rate")), F.abs(F.col("cardinality") - F.col("a_cardinality"))
    kinds = F.array(
        row("null_rate", d_null >= NULL_JUMP, d_null),
        row("cardinality", d_card >= CARDINALITY_JUMP, d_card),
        row("mean_shift", (F.col("a_std") > 0) & (shift > MEAN_SIGMAS), shift),
        row("new_top_values", (F.size(fresh) > 0) & (F.size("a_top") > 0), F.size(fresh)),
    )
    return j.select("column", F.explode(F.array_compact(kinds)).alias("d")).select("column", "d.*")


def snapshot(df: DataFrame, snapshot_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column describing a table at a time: append it to a snapshot table."""
    cols = list(columns) if columns is not None else df.columns
    base = _column_rows(df, cols)
    distinct = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return base.join(F.broadcast(distinct), "column", "left").select(
        F.lit(snapshot_id).alias("snapshot_id"), "column", "kind", "rows", (F.col("rows") - F.col("non_null")).alias("nulls"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "mean", "min", "max",
    )


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select([F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    return left.join(right, F.col("a_column") == F.col("b_column"), "full").withColumn("column", F.coalesce("a_column", "b_column"))


def diff_snapshots(
    before: DataFrame, after: DataFrame, row_warn: float = 0.05, row_fail: float = 0.20, null_warn: float = 0.05, null_fail: float = 0.15,
    mean_warn: float = 0.20, mean_fail: float = 0.50,
) -> DataFrame:
    """Findings between two snapshots: row count, added and removed columns, types, null rates, means."""
    p = _paired(before, after)
    rate = lambda s: F.try_divide(F.col(f"{s}_nulls").cast("double"), F.col(f"{s}_rows"))
    d_null = F.abs(rate("b") - rate("a"))
    d_mean = F.when(F.col("a_mean") != 0, F.abs((F.col("b_mean") - F.col("a_mean")) / F.col("a_mean")))
    grade = lambda d, w, f: F.when(d >= f, "fail").when(d >= w, "warn")
    row = lambda k, st, d: F.when(st.isNotNull(), F.struct(F.lit(k).alias("change"), st.alias("status"), d.cast("double").alias("delta")))
    none = F.lit(None).cast("double")
    per = F.array(
        row("column_added", F.when(F.col("a_column").isNull(), "warn"), none),
        row("column_removed", F.when(F.col("b_column").isNull(), "fail"), none),
        row("type_changed", F.when(F.col("a_kind") != F.col("b_kind"), "warn"), none),
        row("null_rate_shifted", grade(d_null, null_warn, null_fail), F.round(d_null, 6)),
        row("mean_shifted", grade(d_mean, mean_warn, mean_fail), F.round(d_mean, 6)),
    )
    cols = p.select("column", F.explode(F.array_compact(per)).alias("f")).select("column", "f.*")
    counts = p.agg(F.max("a_rows").alias("a"), F.max("b_rows").alias("b"), F.count("a_column").alias("ca"), F.count("b_column").alias("cb"))
    d_rows = F.abs(F.try_divide((F.col("b") - F.col("a")).cast("double"), F.col("a")))
    whole = F.array(
        row("row_count_changed", grade(d_rows, row_warn, row_fail), F.round(d_rows, 6)),
        row("column_count_changed", F.when(F.col("ca") != F.col("cb"), "warn"), (F.col("cb") - F.col("ca"))),
    )
    return cols.unionByName(counts.select(F.lit("*").alias("column"), F.explode(F.array_compact(whole)).alias("f")).select("column", "f.*"))


def diff_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column: deltas between two versions and the risk ``ok``, ``warn`` or ``breaking``."""
    p = _paired(before, after)
    rate = lambda s: F.try_divide(F.col(f"{s}_nulls").cast("double"), F.col(f"{s}_rows"))
    d = rate("b") - rate("a")
    rel = F.when(F.col("a_mean") != 0, F.abs((F.col("b_mean") - F.col("a_mean")) / F.col("a_mean")))
    gone = (F.col("b_distinct_values") == 0) & (F.col("a_distinct_values") > 0)
    flat = (F.col("b_distinct_values") == 1) & (F.col("a_distinct_values") > 1)
    breaking = F.col("b_column").isNull() | (F.col("a_kind") != F.col("b_kind")) | (d > 0.2) | gone | flat | (rel > 0.5)
    warn = F.col("a_column").isNull() | (F.abs(d) > 0.05) | (rel > 0.2)
    return p.select(
        "column", (F.col("b_nulls") - F.col("a_nulls")).alias("null_delta"), F.round(d, 4).alias("null_rate_delta"),
        (F.col("b_distinct_values") - F.col("a_distinct_values")).alias("distinct_delta"), F.round(F.col("b_mean") - F.col("a_mean"), 4).alias("mean_delta"),
        F.when(F.coalesce(breaking, F.lit(False)), "breaking").when(F.coalesce(warn, F.lit(False)), "warn").otherwise("ok").alias("risk"),
    )


def overall_risk(version_diff: DataFrame) -> DataFrame:
    rank = F.when(F.col("risk") == "breaking", 2).when(F.col("risk") == "warn", 1).otherwise(0)
    s = version_diff.agg(F.max(rank).alias("r"), F.count_if(rank > 0).alias("flagged"))
    return s.select(F.when(F.col("r") == 2, "breaking").when(F.col("r") == 1, "warn").otherwise("ok").alias("risk"), "flagged")


# Smoothing and band of the forecast; loads needed.
ALPHA, BETA, BAND, MIN_LOADS = 0.5, 0.3, 2.0, 4


def tracked_statistics(fingerprints: DataFrame, load: str = "load") -> DataFrame:
    """Long series ``(column, kind, load, value)`` from fingerprints: missing share, mean, top share."""
    items = F.array(
        F.struct(F.lit("missing").alias("kind"), F.col("null_rate").alias("value")),
        F.struct(F.lit("mean").alias("kind"), F.when(F.col("kind") == "numeric", F.col("mean")).alias("value")),
        F.struct(F.lit("topprop").alias("kind"), F.when(F.col("kind") == "categorical", F.col("top_prop")).alias("value")),
    )
    return fingerprints.select("column", col(load).alias("load"), F.explode(items).alias("s")).select("column", "s.kind", "load", "s.value").where(F.col("value").isNotNull())


def holt(series: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Linear exponential smoothing of an array of doubles: forecast, trend and residual sigma."""
    first = F.struct(F.element_at(series, 1).alias("level"), (F.element_at(series, 2) - F.element_at(series, 1)).alias("trend"), F.lit(0.0).alias("sse"), F.lit(0).alias("t"))

    def step(s, y):
        guess = s["level"] + s["trend"]
        err = y - guess
        level = alpha * y + (1 - alpha) * guess
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        sse = F.when(s["t"] >= 1, s["sse"] + err * err).otherwise(s["sse"])
        return F.struct(level.alias("level"), trend.alias("trend"), sse.alias("sse"), (s["t"] + 1).alias("t"))

    end = F.aggregate(F.slice(series, 2, F.size(series)), first, step)
    errors = F.size(series) - 2
    return F.struct(
        (end["level"] + end["trend"]).alias("forecast"), end["trend"].alias("trend"), F.when(errors > 0, F.sqrt(end["sse"] / errors)).otherwise(0.0).alias("sigma")
    )


def forecast_bands(history: DataFrame, current: DataFrame, keys: Sequence[str] = ("column", "kind"), z: float = BAND, min_loads: int = MIN_LOADS) -> DataFrame:
    """Expected value and band of every tracked statistic against the current load.

    ``history`` is ``(keys, load, value)``; all loads of a key are folded, one number for each load.
    """
    packed = history.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("load", "value"))).alias("h"))
    s = packed.select(*keys, F.transform("h", lambda x: x["value"]).alias("y")).where(F.size("y") >= min_loads)
    j = s.withColumn("f", holt(F.col("y"))).join(current.select(*keys, F.col("value").alias("actual")), list(keys))
    band = z * F.col("f.sigma")
    low, high = F.col("f.forecast") - band, F.col("f.forecast") + band
    return j.select(
        *keys, F.size("y").cast("long").alias("loads"), F.col("f.forecast").alias("expected"), low.alias("low"), high.alias("high"), "actual", F.col("f.trend").alias("trend"),
        ((F.col("actual") < low) | (F.col("actual") > high)).alias("outside"),
    )


def expected_range(bands: DataFrame, flat_pct: float = 0.5) -> DataFrame:
    """Trend per load in percent of the prior level and its direction, for tracked means."""
    prior = F.col("expected") - F.col("trend")
    pct = F.try_divide(F.col("trend"), F.abs(prior)) * 100
    way = F.when(pct.isNotNull() & (F.abs(pct) < flat_pct), "steady").when(F.col("trend") > 0, "up").when(F.col("trend") < 0, "down").otherwise("steady")
    keep = bands.where(F.col("kind") == "mean") if "kind" in bands.columns else bands
    return keep.withColumns({"trend_pct": pct, "direction": way, "within": ~F.col("outside")})


def status_flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """Layers whose status differs between two runs; a layer absent from one run counts as idle."""
    a = before.select("layer", F.col("status").alias("from"))
    b = after.select("layer", F.col("status").alias("to"))
    idle = F.lit("idle")
    return a.join(b, "layer", "full").select("layer", F.coalesce("from", idle).alias("from"), F.coalesce("to", idle).alias("to")).where(F.col("from") != F.col("to"))


def alert_fingerprint(severity: Column, lines: Column) -> Column:
    """Digest of an alert's content, independent of the order of its lines."""
    return F.sha2(F.concat_ws("::", severity, F.array_join(F.array_sort(lines), "|")), 256)


def new_alerts(alerts: DataFrame, source: str, order: str) -> DataFrame:
    """Alerts that differ from the previous one of the same source; passing alerts are never new."""
    fp = alerts.withColumn("fingerprint", alert_fingerprint(F.col("severity"), F.col("lines")))
    fp = fp.withColumn("_k", F.xxhash64(col(source), "fingerprint"))
    seen = with_order(fp, order, "_k", lag=["fingerprint"], position=None, partition=[source])
    loud = F.col("severity").isin("warn", "fail") & (F.size("lines") > 0)
    return seen.where(loud & ~F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint"))).drop("_k", "prev_fingerprint")


def metric_changes(versions: DataFrame, metric: str = "metric", version: str = "version", definition: str = "definition") -> DataFrame:
    """Consecutive versions of a metric whose definition changed."""
    d = versions.withColumn("_k", F.xxhash64(col(metric)))
    v = with_order(d, version, "_k", lag=[definition], position=None, partition=[metric]).withColumnRenamed(f"prev_{definition}", "previous")
    return v.where(F.col("previous").isNotNull() & (F.col("previous") != col(definition))).select(metric, version, "previous", definition)


def schema_changes(before: DataFrame, after: DataFrame) -> dict[str, list]:
    """Added, removed and retyped columns from the two schemas (driver metadata)."""
    a = {f.name: kind_of(f.dataType) for f in before.schema.fields}
    b = {f.name: kind_of(f.dataType) for f in after.schema.fields}
    return {
        "added": sorted(set(b) - set(a)), "removed": sorted(set(a) - set(b)), "retyped": sorted((c, a[c], b[c]) for c in set(a) & set(b) if a[c] != b[c]),
    }
