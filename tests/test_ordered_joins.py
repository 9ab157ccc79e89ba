"""As-of, interval and gap-breaking operators against brute force."""
from __future__ import annotations

import datetime as dt
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from plumbline.operators.ordered_joins import asof_join, overlap_join, points_in_intervals
from plumbline.operators.stats import fewest_rows_to_break_gap


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof(spark, direction, tolerance):
    """Most rows under one key; ties, nulls, keys of one side only."""
    rng = np.random.default_rng(1)
    key = lambda: [None, "a", "hot", "hot", "hot", "hot", "b"][rng.integers(0, 7)]
    left = [(i, key(), None if i % 17 == 0 else int(rng.integers(0, 400))) for i in range(300)] + [(300, "only left", 5)]
    right, seen = [], set()
    for i in range(200):
        k, t = key(), None if i % 19 == 0 else int(rng.integers(0, 400))
        if t is None or (k, t) not in seen:
            right.append((i, k, t))
            seen.add((k, t))
    l_df, r_df = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "id long, k string, t long")
    got = {r.id: r.id_right for r in asof_join(l_df, r_df, "t", "t", ["k"], direction, tolerance, buckets=7).collect()}
    for i, k, t in left:
        sign = 1 if direction == "backward" else -1
        near = [(sign * (t - u), j) for j, m, u in right if None not in (k, t, u) and m == k and sign * (t - u) >= 0]
        best = min(near, default=(None, None))
        assert got[i] == (best[1] if best[0] is not None and (tolerance is None or best[0] <= tolerance) else None)


def test_asof_without_key(spark):
    left = spark.createDataFrame([(i, float(i)) for i in range(100)], "id long, x double")
    right = spark.createDataFrame([(10.5, "p"), (10.5, "p"), (60.0, "q"), (float("nan"), "r")], "x double, what string")
    got = asof_join(left, right, "x", "x", buckets=9).orderBy("id").collect()
    assert [r.what for r in got] == [None] * 11 + ["p"] * 49 + ["q"] * 40
    assert got[0].asDict().keys() == {"id", "x", "x_right", "what"}
    assert asof_join(left.limit(0), right, "x", "x").collect() == []
    assert {r.what for r in asof_join(left, right.limit(0), "x", "x").collect()} == {None}


def test_asof_equal_places(spark):
    """One place that fills several buckets: right rows there are still found."""
    left = spark.createDataFrame([(i, 5) for i in range(300)], "id long, t int")
    right = spark.createDataFrame([(5, "x"), (4, "y")], "t int, what string")
    assert {r.what for r in asof_join(left, right, "t", "t", buckets=11).collect()} == {"x"}


def test_asof_times(spark):
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, at(100)), (2, at(200))], "id long, ts timestamp")
    right = spark.createDataFrame([(at(70), "x")], "ts timestamp, what string")
    assert [r.what for r in asof_join(left, right, "ts", "ts", tolerance=30).orderBy("id").collect()] == ["x", None]


def spans(rng, n):
    out = []
    for i in range(n):
        a = float(rng.integers(-50, 200)) / 2
        out.append((i, "xy"[i % 2], a, a + [0, 0.5, 3, 40, 1000, -1][rng.integers(0, 6)]))
    return [*out, (n, "x", None, 4.0), (n + 1, "x", 4.0, None), (n + 2, None, 4.0, 5.0)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_intervals(spark, by):
    rng = np.random.default_rng(4)
    left, right = spans(rng, 60), spans(rng, 70)
    schema = "id long, k string, s double, e double"
    l_df, r_df = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    ok = lambda r: None not in r[2:] and r[2] <= r[3]
    same = lambda x, y: not by or x[1] is not None and x[1] == y[1]
    want = Counter((x[0], y[0]) for x in left for y in right if ok(x) and ok(y) and same(x, y) and x[2] <= y[3] and y[2] <= x[3])
    got = overlap_join(l_df, r_df, ("s", "e"), ("s", "e"), by)
    assert Counter((r.id, r.id_right) for r in got.collect()) == want
    want = Counter((x[0], y[0]) for x in left for y in right if x[2] is not None and ok(y) and same(x, y) and y[2] <= x[2] <= y[3])
    assert Counter((r.id, r.id_interval) for r in points_in_intervals(l_df, r_df, "s", "s", "e", by).collect()) == want
    assert overlap_join(l_df.limit(0), r_df, ("s", "e"), ("s", "e"), by).collect() == []


def plain_break(rows, vanish=0.25):
    """The least number of rows to take, over all subsets that leave both groups a row."""
    mean = lambda rs, g: np.mean([v for _, h, v in rs if h == g])
    gap = mean(rows, "a") - mean(rows, "b")
    for k in range(len(rows)):
        for gone in combinations(range(len(rows)), k):
            left = [r for i, r in enumerate(rows) if i not in gone]
            if {g for _, g, _ in left} == {"a", "b"}:
                now = (mean(left, "a") - mean(left, "b")) * np.sign(gap)
                if now <= vanish * abs(gap):
                    return k
    return None


def test_fewest_rows(spark):
    rng = np.random.default_rng(7)
    for _ in range(6):
        n = rng.integers(3, 6, 2)
        rows = [(i, "a", float(rng.integers(0, 30))) for i in range(n[0])] + [(10 + i, "b", float(rng.integers(10, 60))) for i in range(n[1])]
        rows = [(i, g, v + 0.001 * i) for i, g, v in rows]
        df = spark.createDataFrame([*rows, (90, "c", 5.0), (91, "a", None)], "id long, g string, v double")
        r = fewest_rows_to_break_gap(df, "v", "g", "a", "b", "id", ["g"]).first()
        want = plain_break(rows)
        assert r.rows_to_break == want and r["rows"] == len(rows)
        assert want is None or r.from_higher + r.from_lower == want


def test_segment_that_carries(spark):
    """A few rows of one site make the gap."""
    rows = [(i, "a" if i % 2 else "b", f"s{i % 5}", 10.0 + i % 3) for i in range(200)] + [(1000 + i, "a", "odd", 500.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, g string, site string, v double")
    r = fewest_rows_to_break_gap(df, "v", "g", "a", "b", "id", ["site"]).first()
    assert (r.segment, r.segment_share, r.severity) == ("site = odd", 1.0, "fragile") and r.rows_to_break <= 6
    none = fewest_rows_to_break_gap(df.where("g = 'a'"), "v", "g", "a", "b", "id", ["site"]).first()
    assert none.rows_to_break is None
    same = fewest_rows_to_break_gap(spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "id long, g string, v double"), "v", "g", "a", "b", "id").first()
    assert (same.gap, same.rows_to_break, same["mode"]) == (0.0, None, "stable")
