"""File scans with rejected-row counts, type promotion, text lines, sinks."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import with_order
from plumbline.model import col

REJECT = "_rejected"


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and a one-row frame counting those that do not."""
    opts = {"header": header, "sep": sep}
    if schema is None:
        schema = spark.read.options(inferSchema=True, **opts).csv(path).schema
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])
    raw = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT, columnPruning=False, **opts).schema(full).csv(path)
    return raw.where(_accepted(raw)).drop(REJECT), _tally(raw)


def _accepted(raw: DataFrame) -> Column:
    """True for rows that parsed. Spark wants a data column next to the reject column, so one is hashed."""
    return F.col(REJECT).isNull() & (F.hash(col(raw.columns[0])) >= -(2**31))


def _tally(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if(_accepted(raw)).alias("accepted"), F.count_if(~_accepted(raw)).alias("rejected"))


def parse_csv_lines(lines: DataFrame, column: str, schema: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """The same split for text that is already a column: parsed rows and the accept/reject counts."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(REJECT, T.StringType())])
    # the parser is told its schema as DDL; nested-free CSV types print losslessly
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    p = lines.select(F.from_csv(col(column), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT, "sep": sep}).alias("r")).select("r.*")
    return p.where(F.col(REJECT).isNull()).drop(REJECT), _tally(p)


def load_json(spark: SparkSession, path: str, schema=None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def load_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[col(c) for c in columns]) if columns else df


FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text", "log": "text"}


def format_of(path: str) -> str:
    name = re.sub(r"\.(gz|bz2|zst|snappy)$", "", path.lower().split("?")[0])
    ext = name.rsplit(".", 1)[-1]
    if ext not in FORMATS:
        raise ValueError(f"no reader for {path}")
    return FORMATS[ext]


def load_any(spark: SparkSession, path: str, preview: int | None = None) -> DataFrame:
    """Local or object-store path, format by extension; compressed text is read as is."""
    fmt = format_of(path)
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=True, sep="\t" if ".tsv" in path.lower() else ",")
    df = reader.format(fmt).load(path)
    return df.limit(preview) if preview else df


def promote_types(df: DataFrame) -> DataFrame:
    """Text columns become doubles, else dates, where every non-null value converts.

    One aggregate row decides for all columns; one projection applies it.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        v = F.when(F.trim(col(c)) != "", F.trim(col(c)))
        aggs += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("double")).alias(f"d{i}"), F.count(v.try_cast("date")).alias(f"t{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        v = F.when(F.trim(col(c)) != "", F.trim(col(c)))
        if n and row[f"d{i}"] == n:
            out[c] = v.try_cast("double")
        elif n and row[f"t{i}"] == n:
            out[c] = v.try_cast("date")
    return df.withColumns(out) if out else df


def load_text_lines(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    """``(file, line_number, content)``: exact numbers from split offsets, without gathering a file in one task."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("content")
    )
    out = with_order(raw, "_block", "_id", position="line_number", partition=["file"]).select("file", "line_number", "content")
    return out.where(F.trim("content") != "") if skip_empty else out


def text_lines(df: DataFrame, key: str, text: str, skip_empty: bool = False) -> DataFrame:
    """Lines of a text column with their numbers within each text."""
    d = df.select(col(key), F.posexplode(F.split(col(text), "\n")).alias("_n", "content"))
    d = d.select(col(key), (F.col("_n") + 1).cast("long").alias("line_number"), F.regexp_replace("content", "\r$", "").alias("content"))
    return d.where(F.trim("content") != "") if skip_empty else d


# Shapes of log, severity and delimited lines.
LOG_TIME, LOG_LEVEL, DELIMITED = r"^\d{4}-\d{2}-\d{2}|^\[\d{2}[:/]\d{2}", r"(?i)\b(INFO|WARN|WARNING|ERROR|DEBUG|CRITICAL|FATAL|TRACE)\b", r"\t|,(?=\S)"


def text_kind(lines: DataFrame, key: str) -> DataFrame:
    """log, delimited, prose or unknown, from all lines of each text."""
    c = F.col("content")
    g = lines.groupBy(col(key)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c.rlike(LOG_TIME)).alias("t"), F.count_if(c.rlike(LOG_LEVEL)).alias("s"), F.count_if(c.rlike(DELIMITED)).alias("d"), F.count_if(F.length(F.trim(c)) > 40).alias("p")
    )
    kind = F.when((F.col("t") >= 3) | (F.col("s") >= 3), "log").when(F.col("d") >= F.floor(F.col("n") * 0.7), "delimited").when(F.col("p") == F.col("n"), "prose").otherwise("unknown")
    return g.select(col(key), kind.alias("kind"))


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def stats_export(df: DataFrame) -> DataFrame:
    """The per-column summary sink: the column profile with its list column as text."""
    from plumbline.plans.profile import column_profile

    return column_profile(df).withColumn("top_values", F.array_join("top_values", "; "))


def watch_folder(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream; Spark's source log remembers what was read."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differs: ``(path, size, modified)`` against the last listing."""
    sig = lambda d: d.select("path", F.concat_ws("|", "size", "modified").alias("sig"))
    j = sig(files).join(sig(seen).withColumnRenamed("sig", "old"), "path", "left")
    return j.where(~F.col("sig").eqNullSafe(F.col("old"))).select("path", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("change"))
