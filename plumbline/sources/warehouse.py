"""Warehouse and database scans through Spark's JDBC source, with type mapping."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import col

# Warehouse type names and the Spark types they become.
TYPE_MAP = {
    "INT64": "bigint", "INTEGER": "bigint", "INT": "bigint", "SMALLINT": "bigint", "BIGINT": "bigint", "FLOAT64": "double", "FLOAT": "double", "DOUBLE": "double", "NUMERIC": "double", "BIGNUMERIC": "double",
    "DECIMAL": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "STRING": "string", "JSON": "string", "BYTES": "string", "GEOGRAPHY": "string",
}


def apply_type_map(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns to the Spark type of their warehouse type; unknown types stay text."""
    return df.select(*[(col(c).cast("string").try_cast(TYPE_MAP.get(types[c].upper(), "string")).alias(c) if c in types else col(c)) for c in df.columns])


def read_table(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table over JDBC; ``partition`` = (column, lower, upper, count) reads slices in parallel."""
    return _jdbc(spark, url, properties, partition).option("dbtable", table).load()


def read_query(spark: SparkSession, url: str, query: str, properties: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query over JDBC. With partition bounds the query becomes a derived table, one slice per task."""
    if partition:
        return _jdbc(spark, url, properties, partition).option("dbtable", f"({query}) q").load()
    return _jdbc(spark, url, properties, None).option("query", query).load()


def _jdbc(spark: SparkSession, url: str, properties, partition):
    r = spark.read.format("jdbc").option("url", url).options(**dict(properties or {}))
    if partition:
        c, lo, hi, n = partition
        r = r.options(partitionColumn=c, lowerBound=lo, upperBound=hi, numPartitions=n)
    return r


def partition_bounds(df: DataFrame, column: str, parts: int) -> DataFrame:
    """The bounds query for a partitioned read: min, max and slice count."""
    return df.agg(F.min(col(column)).alias("lower"), F.max(col(column)).alias("upper")).withColumn("parts", F.lit(parts))
