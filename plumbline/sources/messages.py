"""Message payloads: format detection, parsing with errors kept, schema inference, subjects, batches."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import col
from plumbline.session import spread


def _is_object(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull() & F.startswith(F.trim(text), F.lit("{"))


def detect_format(value: Column) -> Column:
    """binary, ndjson, json or csv for a binary or text payload."""
    raw = value.cast("binary")
    text = F.trim(F.try_validate_utf8(raw.cast("string")))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.size(F.filter(lines, lambda x: F.try_parse_json(x).isNotNull()))
    return (
        F.when(text.isNull() | (text == ""), "binary")
        .when((F.size(lines) >= 2) & (good >= F.ceil(F.size(lines) / 2)), "ndjson")
        .when(text.rlike(r"^[{\[]"), "json")
        .otherwise("csv")
    )


def _csv_cells(text: Column) -> Column:
    parts = F.split(text, r""",(?=(?:[^"]*"[^"]*")*[^"]*$)""")
    return F.transform(parts, lambda p: F.trim(F.regexp_replace(p, '"', "")))


def parse_messages(df: DataFrame, value: str = "value", keys: Sequence[str] = (), headers: Sequence[str] | None = None) -> DataFrame:
    """One row per record: ``(keys, format, record, error)``; ``record`` is JSON text, null where parsing failed.

    Bad payloads and bad lines stay as rows with an error, so nothing is dropped.
    """
    fmt = detect_format(col(value))
    d = df if df.isStreaming else spread(df.select(*[col(k) for k in keys], col(value)))
    d = d.select(*[col(k) for k in keys], fmt.alias("format"), col(value).cast("binary").alias("_raw"))
    text = F.trim(F.col("_raw").cast("string"))
    rec = lambda r, e: F.struct(r.cast("string").alias("record"), e.cast("string").alias("error"))
    none = F.lit(None)
    variant = F.try_parse_json(text)
    items = F.try_variant_get(variant, "$", "array<variant>")
    array_rows = F.transform(items, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), rec(F.to_json(v), none)).otherwise(rec(none, F.lit("array element is not an object"))))
    json_rows = (
        F.when(variant.isNull(), F.array(rec(none, F.lit("invalid JSON"))))
        .when(items.isNotNull(), array_rows)
        .when(F.schema_of_variant(variant).startswith("OBJECT"), F.array(rec(text, none)))
        .otherwise(F.array(rec(none, F.lit("not an object or array of objects"))))
    )
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    nd_rows = F.transform(lines, lambda x: F.when(_is_object(x), rec(x, none)).otherwise(rec(none, F.lit("line is not a JSON object"))))
    cells = _csv_cells(text)
    auto = F.transform(F.sequence(F.lit(1), F.size(cells)), lambda i: F.concat(F.lit("col"), i.cast("string")))
    if headers:
        names = F.when(F.size(cells) == len(headers), F.array(*[F.lit(h) for h in headers])).otherwise(auto)
        bad = F.when(F.size(cells) != len(headers), F.lit("header length differs from field count"))
    else:
        names, bad = auto, none
    typed = F.map_from_arrays(names, F.transform(cells, lambda c: F.when(c != "", c)))
    csv_rows = F.array(rec(F.to_json(typed, {"ignoreNullFields": "false"}), bad))
    blob = F.when(F.length("_raw") == 0, F.array(rec(none, F.lit("empty payload")))).otherwise(F.array(rec(F.to_json(F.struct(F.base64("_raw").alias("raw_base64"))), none)))
    rows = F.when(F.col("format") == "binary", blob).when(F.col("format") == "json", json_rows).when(F.col("format") == "ndjson", nd_rows).otherwise(csv_rows)
    return d.select(*[col(k) for k in keys], "format", F.explode(rows).alias("r")).select(*[col(k) for k in keys], "format", "r.record", "r.error")


def infer_record_schema(records: DataFrame, record: str = "record") -> DataFrame:
    """Column types over a batch: BOOLEAN, INTEGER widening to DOUBLE, TIMESTAMP, else VARCHAR; null counts."""
    total = records.agg(F.count(F.lit(1))).scalar()
    kv = records.select(F.explode(F.from_json(col(record), "map<string,string>")).alias("name", "v"))
    v = F.col("v")
    kind = (
        F.when(v.isNull() | (v == ""), "NULL").when(v.rlike(r"^-?\d+$"), "INTEGER").when(v.rlike(r"^-?\d*\.\d+([eE][-+]?\d+)?$"), "DOUBLE").when(v.isin("true", "false"), "BOOLEAN")
        .when(v.rlike(r"\d{4}-\d{2}-\d{2}") & v.try_cast("timestamp").isNotNull(), "TIMESTAMP").otherwise("VARCHAR")
    )
    g = kv.withColumn("kind", kind).groupBy("name").agg(F.count_if(F.col("kind") != "NULL").alias("filled"), F.sort_array(F.collect_set(F.when(F.col("kind") != "NULL", F.col("kind")))).alias("kinds"))
    k = F.col("kinds")
    t = F.when(F.size(k) == 0, "VARCHAR").when(F.size(k) == 1, F.try_element_at(k, F.lit(1))).when(F.size(F.array_except(k, F.array(F.lit("INTEGER"), F.lit("DOUBLE")))) == 0, "DOUBLE").otherwise("VARCHAR")
    return g.select("name", t.alias("type"), (total - F.col("filled")).alias("null_count"))


def subject_matches(subject: Column, pattern: str) -> Column:
    """Dotted subjects: ``*`` matches one token, a final ``>`` one or more."""
    if not pattern.strip():
        return F.lit(False)
    toks = []
    for p in pattern.split("."):
        if p == ">":
            toks.append(r".+")
            break
        toks.append(r"[^.]+" if p == "*" else re.escape(p))
    return F.coalesce(subject.rlike("^" + r"\.".join(toks) + "$"), F.lit(False))


def batch_report(df: DataFrame, required: Sequence[str], key: str | None = None) -> DataFrame:
    """A posted batch: rows, missing required values, repeated keys, order-free digest, status."""
    h = F.xxhash64(*[col(c) for c in df.columns]).cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(h).cast("string"), F.min(h).cast("string"), F.max(h).cast("string")), 256).alias("digest")]
    aggs += [F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(required)]
    s = df.agg(*aggs)
    missing = sum((F.col(f"m{i}") for i in range(len(required))), F.lit(0))
    dup = F.lit(0)
    if key:
        g = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("c"))
        dup = g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).scalar()
    status = F.when(F.col("rows") == 0, "fail").when((missing > 0) | (dup > 0), "warn").otherwise("pass")
    return s.select("rows", missing.cast("long").alias("missing_required"), dup.cast("long").alias("repeated_keys"), "digest", status.alias("status"))
