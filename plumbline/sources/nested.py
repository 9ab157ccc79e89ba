"""Nested JSON to flat tables, API payload rows, health-record bundles."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import col
from plumbline.session import spread


def infer_json(df: DataFrame, column: str) -> str:
    """Schema of a JSON text column as DDL, merged over all rows in one aggregate."""
    s = df.agg(F.schema_of_variant_agg(F.try_parse_json(col(column)))).first()[0]
    return re.sub(r"OBJECT<", "STRUCT<", s or "STRUCT<>").replace("VOID", "STRING")


def parse_json_column(df: DataFrame, column: str, schema: str | None = None, into: str = "json") -> DataFrame:
    return df.withColumn(into, F.from_json(col(column), schema or infer_json(df, column)))


def _first_object_array(t: T.DataType, path: tuple[str, ...] = (), depth: int = 4) -> tuple[str, ...] | None:
    if not isinstance(t, T.StructType) or depth < 0:
        return None
    for f in t.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return (*path, f.name)
        found = _first_object_array(f.dataType, (*path, f.name), depth - 1)
        if found:
            return found
    return None


def _leaves(c: Column, t: T.DataType, name: str, depth: int) -> list[Column]:
    if isinstance(t, T.StructType) and depth > 0:
        return [x for f in t.fields for x in _leaves(c.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name, depth - 1)]
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return [F.to_json(c).alias(name)]
    return [c.alias(name)]


def flatten(df: DataFrame, max_depth: int = 4, arrays_as_json: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Structs become dotted columns down to ``max_depth``; arrays and deeper structs become JSON text."""
    out = [col(k) for k in keep]
    for f in df.schema.fields:
        if f.name in keep:
            continue
        if isinstance(f.dataType, T.ArrayType) and not arrays_as_json:
            out.append(col(f.name))
        else:
            out += _leaves(col(f.name), f.dataType, f.name, max_depth)
    return df.select(*out)


def records(df: DataFrame, column: str, max_depth: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows inside a parsed payload: the first array of objects if there is one, else the object itself."""
    t = df.schema[column].dataType
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        r = df.select(*[col(k) for k in keep], F.explode(col(column)).alias("_r"))
    else:
        path = _first_object_array(t)
        target = col(column)
        for p in path or ():
            target = target.getField(p)
        r = df.select(*[col(k) for k in keep], (F.explode(target) if path else target).alias("_r"))
    flat = r.select(*[col(k) for k in keep], *_leaves(F.col("_r"), r.schema["_r"].dataType, "", max_depth + 1))
    return flat


def api_rows(df: DataFrame, payload: str, schema: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of polled API responses landed as JSON text."""
    return records(parse_json_column(df, payload, schema, "_payload"), "_payload", keep=keep)


# The bundle fields that are read.
_REF = "struct<reference:string>"
_CODE = "struct<text:string,coding:array<struct<code:string,display:string>>>"
BUNDLE = (
    "struct<resourceType:string,entry:array<struct<resource:struct<resourceType:string,id:string,gender:string,birthDate:string,"
    f"subject:{_REF},code:{_CODE},onsetDateTime:string,valueQuantity:struct<value:double,unit:string,code:string>,effectiveDateTime:string,"
    "class:struct<code:string,display:string>,period:struct<start:string,end:string>,age:double>>>>"
)


def bundle_entries(df: DataFrame, column: str) -> DataFrame:
    b = spread(df.select(col(column))).select(F.from_json(col(column), BUNDLE).alias("b")).where(F.col("b.resourceType") == "Bundle")
    return b.select(F.explode("b.entry").alias("e")).select("e.resource.*")


def bundle_tables(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """Patient, Condition, Observation and Encounter tables of health-record bundles."""
    e = bundle_entries(df, column)
    ref = F.regexp_extract(F.coalesce(F.col("subject.reference"), F.lit("")), r"([^/:]+)$", 1)
    code = F.coalesce(F.col("code.text"), F.col("code.coding")[0]["display"], F.col("code.coding")[0]["code"], F.lit(""))
    pick = lambda kind, *cols: e.where(F.col("resourceType") == kind).select("id", *cols)
    return {
        "Patient": pick("Patient", "gender", F.col("birthDate").alias("birth_date")),
        "Condition": pick("Condition", ref.alias("patient"), code.alias("code"), F.col("onsetDateTime").alias("onset")),
        "Observation": pick("Observation", ref.alias("patient"), code.alias("code"), F.col("valueQuantity.value").alias("value"), F.coalesce("valueQuantity.unit", "valueQuantity.code").alias("unit"), F.col("effectiveDateTime").alias("effective")),
        "Encounter": pick("Encounter", ref.alias("patient"), F.coalesce("class.code", "class.display").alias("class"), F.col("period.start").alias("start"), F.col("period.end").alias("end"), "age"),
    }


def observation_limits(observations: DataFrame) -> DataFrame:
    """Observations outside plausible limits for the vital sign their code names."""
    from plumbline.plans.checks import VITALS

    toks = F.split(F.lower("code"), "[^a-z0-9]+")
    low, high, kind = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, codes, stems, lo, hi in reversed(VITALS):
        if lo is None:
            continue
        hit = F.exists(toks, lambda w: w.isin(*codes) | w.rlike("^(" + "|".join(stems) + ")"))
        low, high, kind = F.when(hit, float(lo)).otherwise(low), F.when(hit, float(hi)).otherwise(high), F.when(hit, name).otherwise(kind)
    o = observations.withColumns({"vital": kind, "low": low, "high": high})
    return o.where(F.col("vital").isNotNull() & ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))))
