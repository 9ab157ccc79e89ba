"""Noised sums: what one person can change, the bound that is found, defined results at the edges."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import privacy as P


def table(spark, n=400):
    """One person holds a third of the rows; rows without a person, a null group, nulls, non-finite and very large values."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        who = None if i % 29 == 0 else "hot" if i % 3 == 0 else f"p{i % 40}"
        v = None if i % 31 == 0 else math.nan if i % 37 == 0 else math.inf if i % 41 == 0 else -1e9 if i % 43 == 0 else float(rng.normal(5, 3))
        rows.append((i, who, [None, "a", "b", "c"][int(rng.integers(0, 4))], v, "kept"))
    return spark.createDataFrame(rows, "id long, who string, g string, v double, _who string")


def test_any_one_person_changes_no_more_than_the_bound(spark):
    d = table(spark).cache()
    whole = {r.key: (r.total, r.n) for r in P.bounded_sums(d, "g", "v", "who", "id", "s", 4, 8.0).collect()}
    people = [r.who for r in d.where("who is not null").select("who").distinct().orderBy("who").limit(12).collect()]
    lone = d.where("who is null and v between -1e6 and 1e6").orderBy("id").first().id
    for left_out in [F.col("who") == p for p in people] + [F.col("who").isNull() & (F.col("id") == lone)]:
        rest = {r.key: (r.total, r.n) for r in P.bounded_sums(d.where(~F.coalesce(left_out, F.lit(False))), "g", "v", "who", "id", "s", 4, 8.0).collect()}
        change = [tuple(whole[k][i] - rest.get(k, (0.0, 0))[i] for k in whole) for i in (0, 1)]
        assert 0 < sum(map(abs, change[1])) <= 4 and sum(map(abs, change[0])) <= 4 * 8.0 + 1e-9
    kept = P.bounded_rows(d, "who", "id", "s", 4)
    assert kept.columns == d.columns and kept.where("_who = 'kept'").count() == kept.count()
    assert {r.n for r in kept.where("who is not null").groupBy("who").agg(F.count("*").alias("n")).collect()} == {4}
    assert kept.where("who is null").count() == d.where("who is null").count()


def test_bound_and_noise(spark):
    d = spark.range(20_000).selectExpr("id", "id % 5000 as who", "cast(id % 2 as string) as g", "100.0 + id % 20 as v")
    s = {r.key: r for r in P.noised_sums(d, "g", "v", "who", "id", 2.0, "s", 4).collect()}
    again = {r.key: r for r in P.noised_sums(d.repartition(5), "g", "v", "who", "id", 2.0, "s", 4).collect()}
    for k, r in s.items():
        assert r.bound == 128 and r.mean == pytest.approx(109 + int(k), rel=0.05) and r.n == pytest.approx(10_000, rel=0.05)
        assert r.total != 10_000 * (109.5 + int(k)) and again[k].total == pytest.approx(r.total)
    # noise of the stated size: mean absolute Laplace noise is its scale
    many = spark.range(4000).selectExpr("id", "id as who", "id as g", "1.0 as v")
    r = P.noised_sums(many, "g", "v", "who", "id", 1.0, "s", 3, bound=2.0).agg(F.avg(F.abs(F.col("total") - 1)).alias("m")).first()
    assert r.m == pytest.approx(2.0 * 3 / 0.5, rel=0.1)


def test_edges(spark):
    d = table(spark)
    assert P.noised_sums(d.limit(0), "g", "v", "who", "id", 1.0, "s").isEmpty()
    assert P.noised_sums(d.where("v is null"), "g", "v", "who", "id", 1.0, "s").isEmpty()
    assert {r.key for r in P.noised_sums(d, "g", "v", "who", "id", 1.0, "s").collect()} == {None, "a", "b", "c"}
    for bad in (dict(epsilon=0.0), dict(secret=""), dict(max_rows=0), dict(bound=0.0)):
        with pytest.raises(ValueError):
            P.noised_sums(d, "g", "v", "who", "id", **{"epsilon": 1.0, "secret": "s", **bad}).collect()
