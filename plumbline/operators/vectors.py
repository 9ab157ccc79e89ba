"""Vector search by cosine similarity."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import col
from plumbline.session import tasks

BLOCK = 1000  # query vectors


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 when either has no length."""
    return F.coalesce(F.try_divide(_dot(a, b), _norm(a) * _norm(b)), F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def top_k(
    vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 5
) -> DataFrame:
    """The k most similar vectors for every query vector: ``(query_key, key, score, rank)``.

    Query vectors travel in blocks of about ``BLOCK``, each block once for every slice of the
    vectors, so any number of queries meets all vectors without one task holding either side.
    Each partition keeps k rows per query before the shuffle.
    """
    n_blocks = max(1, math.ceil(queries.count() / BLOCK))
    slices = tasks(vectors)
    q = queries.select(col(query_key).alias("_q"), col(query_vector).cast("array<double>").alias("_v"))
    packed = q.groupBy(F.pmod(F.xxhash64("_q"), F.lit(n_blocks)).alias("_block")).agg(F.collect_list(F.struct("_q", "_v", _norm(F.col("_v")).alias("_l"))).alias("_set"))
    blocks = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    e = col(vector).cast("array<double>")
    # lengths are worked out once per vector; a pair costs one dot product
    v = vectors.select(col(key), e.alias("_e"), _norm(e).alias("_n"), F.pmod(F.xxhash64(col(key)), F.lit(slices)).cast("long").alias("_slice"))
    v = v.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    score = F.coalesce(F.try_divide(_dot(F.col("_e"), F.col("_x._v")), F.col("_n") * F.col("_x._l")), F.lit(0.0))
    met = v.join(blocks, ["_block", "_slice"]).withColumn("_x", F.explode("_set"))
    pairs = met.select(F.col("_x._q").alias(query_key), col(key), score.alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), F.asc(key))
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
