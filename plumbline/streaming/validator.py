"""Micro-batch validation with carried baselines, on Structured Streaming."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import col, kind_of

MEAN_SIGMAS, NULL_JUMP, ARRIVAL = 2.5, 0.1, 0.3


def schema_text(schema: T.StructType) -> str:
    return ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields))


def batch_statistics(df: DataFrame, watch: Sequence[str], batch: Column) -> DataFrame:
    """One row per (batch, column): rows, null ratio, mean, sigma. One grouped pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(watch):
        x = col(c).cast("double") if kind_of(df.schema[c].dataType) == "number" else F.lit(None).cast("double")
        blank = col(c).isNull() | (col(c).cast("string") == "")
        aggs += [F.count_if(blank).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    g = df.groupBy(batch.alias("batch")).agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), (F.col(f"n{i}") / F.col("rows")).alias("null_ratio"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sigma")) for i, c in enumerate(watch)]
    return g.select("batch", "rows", F.explode(F.array(*cells)).alias("c")).select("batch", "rows", "c.*")


def judge(stats: DataFrame, previous: dict[str, Column], sigmas: float = MEAN_SIGMAS, tolerance: float = ARRIVAL) -> DataFrame:
    """Add drift flags and a status given columns that hold the previous batch's numbers."""
    p_rows, p_null, p_mean, p_sd = previous["rows"], previous["null_ratio"], previous["mean"], previous["sigma"]
    arrival = F.coalesce((F.col("rows") < p_rows * (1 - tolerance)) | (F.col("rows") > p_rows * (1 + tolerance)), F.lit(False))
    shift = F.coalesce((p_sd > 0) & (F.abs(F.col("mean") - p_mean) > sigmas * p_sd), F.lit(False))
    spike = F.coalesce(F.col("null_ratio") > p_null + NULL_JUMP, F.lit(False))
    status = F.when(arrival | shift, "fail").when(spike, "warn").otherwise("pass")
    return stats.withColumns({"arrival_anomaly": arrival, "mean_shift": shift, "null_spike": spike, "status": status, "first": p_rows.isNull()})


def validate_windows(df: DataFrame, watch: Sequence[str], batch: Column) -> DataFrame:
    """Validate event-time batches against the one before: same rules as the stream, over a table."""
    s = batch_statistics(df, watch, batch)
    # one row per batch and column
    w = Window.partitionBy("column").orderBy("batch")
    prev = {k: F.lag(k).over(w) for k in ("rows", "null_ratio", "mean", "sigma")}
    held = s.withColumns({f"_p_{k}": v for k, v in prev.items()})
    out = judge(held, {k: F.col(f"_p_{k}") for k in prev})
    return out.drop(*[f"_p_{k}" for k in prev])


FINDINGS = "stream string, batch_id bigint, column string, rows bigint, null_ratio double, mean double, sigma double, schema string, schema_drift boolean, arrival_anomaly boolean, mean_shift boolean, null_spike boolean, status string"


class StreamValidator:
    """Validates each micro-batch against the last and appends findings under ``folder``.

    A batch writes its own ``batch_id`` folder in overwrite mode, and reads only smaller ids,
    so a replayed batch gives the same rows and is never counted twice.

    The baseline is carried in two slots beside the findings, one row per watched column in each. A batch
    judges against the later slot below its own id and then overwrites the other, so its work does not
    grow with the batches before it, and a batch that fails halfway leaves the slot that it needs. A batch older
    than both slots, which a stream does not replay by itself, is judged against the findings.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, watch: Sequence[str]):
        self.spark, self.name, self.folder, self.watch = spark, name, folder.rstrip("/"), list(watch)

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/stream={self.name}/batch_id={batch_id}"

    def findings(self) -> DataFrame:
        """All batches so far; empty when none has run."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(FINDINGS).parquet(self.folder).where(F.col("stream") == self.name)
        except AnalysisException:
            return self.spark.createDataFrame([], FINDINGS)

    def _slot(self, slot: int) -> str:
        # names that start with an underscore are no data to a reader of the folder
        return f"{self.folder}/_baseline/{self.name}/{slot}"

    def _held(self) -> dict[int, int]:
        """Batch id in each slot that is whole."""
        from pyspark.errors import AnalysisException

        held = {}
        for slot in (0, 1):
            try:
                row = self.spark.read.schema(FINDINGS).parquet(self._slot(slot)).select("batch_id").head()
            except AnalysisException:
                row = None
            if row is not None:
                held[slot] = row.batch_id
        return held

    def baseline(self, before: int) -> DataFrame:
        held = self._held()
        earlier = {i: slot for slot, i in held.items() if i < before}
        if earlier:
            return self.spark.read.schema(FINDINGS).parquet(self._slot(earlier[max(earlier)]))
        # no slot: the first batch, one before both slots, or a folder written before there were slots
        f = self.findings().where(F.col("batch_id") < before)
        last = f.agg(F.max("batch_id")).scalar()
        return f.where(F.col("batch_id") == last)

    def _carry(self, batch_id: int) -> None:
        held = self._held()
        if any(i > batch_id for i in held.values()):
            return
        same = [slot for slot, i in held.items() if i == batch_id]
        free = [slot for slot in (0, 1) if slot not in held]
        slot = (same or free or sorted(held, key=held.get))[0]
        done = self.spark.read.schema(FINDINGS).parquet(self._path(batch_id))
        carried = done.withColumns({"stream": F.lit(self.name), "batch_id": F.lit(batch_id).cast("long")})
        carried.coalesce(1).write.mode("overwrite").parquet(self._slot(slot))  # one row per watched column

    def process(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        shape = schema_text(batch.schema)
        s = batch_statistics(batch, self.watch, F.lit(batch_id)).drop("batch")
        old = self.baseline(batch_id).select(F.col("column").alias("_c"), *[F.col(k).alias(f"_p_{k}") for k in ("rows", "null_ratio", "mean", "sigma", "schema")])
        j = s.join(F.broadcast(old), F.col("column") == F.col("_c"), "left")  # one row per watched column
        out = judge(j, {k: F.col(f"_p_{k}") for k in ("rows", "null_ratio", "mean", "sigma")})
        drift = F.coalesce(F.col("_p_schema") != shape, F.lit(False))
        out = out.withColumns({"schema": F.lit(shape), "schema_drift": drift, "status": F.when(drift, "fail").otherwise(F.col("status"))})
        keep = [c.split()[0] for c in FINDINGS.split(", ") if c.split()[0] not in ("stream", "batch_id")]
        out.select(*keep).write.mode("overwrite").parquet(self._path(batch_id))
        self._carry(batch_id)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        w = stream.writeStream.foreachBatch(lambda df, i: self.process(df, i)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()


def session_totals(findings: DataFrame) -> DataFrame:
    """Running totals over a stream's batches. Batches collapse to one row each first."""
    per = findings.groupBy("stream", "batch_id").agg(F.max("rows").alias("rows"), F.count_if(F.col("status") != "pass").alias("issues"), F.max((F.col("status") == "fail").cast("int")).alias("failed"))
    w = Window.partitionBy("stream").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumns({"total_rows": F.sum("rows").over(w), "total_issues": F.sum("issues").over(w), "failed_batches": F.sum("failed").over(w)})


def batch_changes(findings: DataFrame) -> DataFrame:
    """Schema change and row-rate between consecutive batches of a stream."""
    per = findings.groupBy("stream", "batch_id").agg(F.max("rows").alias("rows"), F.max("schema").alias("schema"))
    w = Window.partitionBy("stream").orderBy("batch_id")
    p = per.withColumns({"_r": F.lag("rows").over(w), "_s": F.lag("schema").over(w)})
    return p.where(F.col("_r").isNotNull()).select("stream", "batch_id", "rows", F.round(F.col("rows") / F.col("_r"), 6).alias("rate"), (F.col("schema") != F.col("_s")).alias("schema_changed"))


def windowed(df: DataFrame, ts: str, key: Sequence[str], aggregates: dict[str, Column], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time aggregates; ``late`` sets the watermark on a stream."""
    d = df.withColumn(ts, col(ts).cast("timestamp"))
    if late:
        d = d.withWatermark(ts, late)
    g = d.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *[col(k) for k in key])
    return g.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *key, *aggregates)


def sessions(df: DataFrame, ts: str, key: Sequence[str], gap: str, aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Session windows per key: a new session after a quiet gap."""
    d = df.withColumn(ts, col(ts).cast("timestamp"))
    if late:
        d = d.withWatermark(ts, late)
    g = d.groupBy(F.session_window(ts, gap), *[col(k) for k in key])
    return g.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *key, *aggregates)


def dedupe_alerts(stream: DataFrame, ts: str, fingerprint: str, late: str = "1 day") -> DataFrame:
    """Drop repeated alerts within the watermark, by content digest."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([fingerprint])


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet files and read them back."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(folder)

