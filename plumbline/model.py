"""Data model shared by all operators: column kinds, findings rows, rule records."""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("detail", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Dataset:
    """A named DataFrame with the time it was loaded."""

    name: str
    df: DataFrame
    loaded_at: datetime = field(default_factory=datetime.now)

    def register(self) -> "Dataset":
        self.df.createOrReplaceTempView(self.name)
        return self


@dataclass(frozen=True)
class Rule:
    """One row-level check: ``condition`` holds on rows that violate it."""

    rule: str
    columns: tuple[str, ...]
    condition: Column
    layer: str = "custom"
    severity: str = "hard"
    detail: str = ""
    applicable: Column | None = None


def col(name: str) -> Column:
    """Column reference that survives dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "number")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "text")


def matching(names: Iterable[str], pattern: str) -> list[str]:
    rx = re.compile(pattern, re.IGNORECASE)
    return [n for n in names if rx.search(n)]


def is_missing(c: Column, blank_is_null: bool = False, text: bool = True) -> Column:
    if blank_is_null and text:
        return c.isNull() | (F.trim(c.cast("string")) == "")
    return c.isNull()


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def stack_structs(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One output row per struct for every input row (used on one-row aggregates)."""
    return df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def finding(
    layer: str,
    rule: Column | str,
    columns: Sequence[str],
    status: Column,
    severity: Column | str,
    count: Column,
    rate: Column,
    detail: Column | str = "",
) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    return F.struct(
        F.lit(layer).alias("layer"),
        as_col(rule).alias("rule"),
        names.alias("columns"),
        status.alias("status"),
        as_col(severity).alias("severity"),
        count.cast("long").alias("count"),
        rate.cast("double").alias("rate"),
        as_col(detail).cast("string").alias("detail"),
    )


def rate_status(rate: Column, warn: float, fail: float, hard: bool = False) -> Column:
    """pass/warn/fail by rate bands; a hard rule fails on any violation."""
    if hard:
        return F.when(rate > 0, "fail").otherwise("pass")
    return F.when(rate >= fail, "fail").when(rate >= warn, "warn").otherwise("pass")
