"""Shared scans in portions that the JVM compiles, and their results on odd input (F8, F9)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.stats import exact_quantiles
from plumbline.plans import layers
from plumbline.plans.scans import AT_ONCE, Part, told, totals


def plans(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_portions(spark):
    df = spark.range(100).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(9)])
    parts = [layers.benford_part(df.columns), layers.correlation_part([(a, b) for a in df.columns for b in df.columns if a < b])]
    parts.append(Part({f"n{i}": F.sum(F.col("c0") + i) for i in range(AT_ONCE + 5)}, lambda at: []))
    row = totals(df, parts)
    # the aggregates of digits and correlations do not stand side by side, and none keeps sets of objects
    assert "ObjectHashAggregate" not in plans(row)
    assert plans(row).count("Generate") >= 2
    got = row.first()
    assert [got[f"p2_n{i}"] for i in range(AT_ONCE + 5)] == [4950 + 100 * i for i in range(AT_ONCE + 5)]
    assert all(abs(got[f"p1_r{i}"] - 1) < 1e-9 for i in range(36))


def test_digits_of_odd_numbers(spark):
    values = [None, 0.0, 0.5, 1.0, -9.99, 10.0, 1e64, 1e63, 1e308, float("inf"), 1.5e128]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    part = layers.benford_part(["x"])
    got = totals(df, [part]).first().asDict()
    assert (got["p0_n0"], got["p0_nn0"], got["p0_nb0"]) == (8, 10, 8)
    assert got["p0_o0"] == 7  # 0, 1, 63, 64, 128, 308 and infinity
    none = df.where("false")
    got = totals(none, [part]).first().asDict()
    assert set(got.values()) == {0}
    assert told(totals(none, [part]), [part]).first().skipped == "small_sample"
    assert totals(none, [layers.correlation_part([("x", "x")])]).first()[0] is None


def test_quantile_bands_without_filter(spark):
    n = 60_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 1000).cast("double").alias("b"))
    rows = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    # a filter on the bands is pushed below the columns and works them out once per check
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    assert "Filter" not in below.split("Range")[0]
    x = {"a": np.arange(n), "b": np.array([i % 1000 for i in range(n) if i % 3])}
    for r in rows.collect():
        assert r.value == np.quantile(x[r.column], r.prob)
