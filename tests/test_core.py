"""Ordering, quantiles, components and signatures against brute force."""
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import stats as fstats
from plumbline.functions.distributions import chi_square_tail, t_two_sided
from plumbline.functions.ordering import with_order
from plumbline.functions.text import _jaro_winkler, edit_signatures, jaro_signatures
from plumbline.operators.clean import scan_issues, spelling_column
from plumbline.operators.fuzzy import connected_components, fuzzy_duplicates, similar_values


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("buckets", [8, 80])
def test_order_with_one_hot_value(spark, buckets):
    rng = random.Random(3)
    rows = [(rng.choice([5] * 40 + list(range(60))), i, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "o long, k long, v double")
    got = with_order(df, "o", "k", lag=["v"], running_sum=["v"], buckets=buckets).orderBy("_pos").collect()
    want = sorted(rows)
    assert [(r.o, r.k) for r in got] == [w[:2] for w in want]
    assert [r._pos for r in got] == list(range(1, 901))
    assert [r.prev_v for r in got] == [None] + [w[2] for w in want][:-1]
    assert np.allclose([r.run_v for r in got], np.cumsum([w[2] for w in want]))


def test_order_within_partitions(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 37) % 50, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, k long")
    got = with_order(df, "o", "k", lag=["k"], partition=["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for g, rs in by.items():
        want = sorted((o, k) for gg, o, k in rows if gg == g)
        rs.sort(key=lambda r: r._pos)
        assert [(r.o, r.k) for r in rs] == want
        assert [r.prev_k for r in rs] == [None] + [k for _, k in want][:-1]


@pytest.mark.parametrize("limit", [4, 50_000])
def test_exact_quantiles_narrowing(spark, monkeypatch, limit):
    monkeypatch.setattr(fstats, "BAND_ROWS", limit)
    monkeypatch.setattr(fstats, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    y = rng.integers(0, 6, size=4500).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = fstats.quantile_map(df, ["x", "y"], probs)
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(x, p), abs=1e-12)
        assert got["y", p] == pytest.approx(np.quantile(y, p), abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert fstats.quantile_map(df, ["x"], [0.5]) == {("x", 0.5): None}


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("hub", f"h{i}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}


words = st.text(alphabet="abcdef ", min_size=1, max_size=14)


@settings(max_examples=400, deadline=None)
@given(words, words, st.sampled_from([0.82, 0.85, 0.9]))
def test_signatures_never_miss(a, b, threshold):
    a, b = sorted((a, b), key=len)
    if 1 - edit_distance(a, b) / max(len(a), len(b)) >= threshold:
        assert edit_signatures(a, threshold, False) & edit_signatures(b, threshold, True)
    if _jaro_winkler(a, b) >= threshold:
        assert jaro_signatures(a, threshold, False) & jaro_signatures(b, threshold, True)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(st.tuples(st.integers(0, 13), st.sampled_from("abz"), st.sampled_from("ids")), max_size=2))
def test_signatures_find_small_edits(a, edits):
    b = a
    for at, ch, op in edits:
        at = min(at, len(b))
        b = b[:at] + ch + b[at:] if op == "i" else b[:at] + b[at + 1 :] if op == "d" else b[:at] + ch + b[at + 1 :]
    if b:
        x, y = sorted((a, b), key=len)
        if 1 - edit_distance(x, y) / max(len(x), len(y)) >= 0.82:
            assert edit_signatures(x, 0.82, False) & edit_signatures(y, 0.82, True)


def test_similar_values_against_all_pairs(spark):
    rng = random.Random(4)
    first, last = ["jonathan", "maria", "wei", "omar", "lucy"], ["meyer", "meyar", "smith", "smyth", "garcia"]
    names = sorted({f"{rng.choice(first)} {rng.choice(last)}{'x' * rng.randrange(2)}" for _ in range(60)})
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = {(r.value_a, r.value_b) for r in similar_values(df, "v").collect()}
    want = {
        (a, b) for a, b in itertools.combinations(names, 2) if max(1 - edit_distance(a, b) / max(len(a), len(b)), _jaro_winkler(a, b)) > 0.85
    }
    assert got == want


def test_seeded_near_duplicates_found_and_ids_refused(spark):
    people = ["Jonathan Meyer", "Priya Natarajan", "Carlos Mendoza", "Helena Fischer", "Yuki Tanaka", "Abdul Rahman"]
    near = ["Jonathan Meyar", "Priya Natarajen", "Carlos Mendosa", "Helena Fisher", "Yuki Tanakka", "Abdul Rahmen"]
    other = ["Zoe Quill", "Bjorn Axelsen", "Tamsin Oakes"]
    df = spark.createDataFrame([(n,) for n in people + near + other], "patient_name string")
    got = {frozenset((r.value_a, r.value_b)) for r in fuzzy_duplicates(df, "patient_name").collect()}
    assert got == {frozenset(p) for p in zip(people, near)}
    with pytest.raises(ValueError):
        fuzzy_duplicates(df.withColumnRenamed("patient_name", "claim_id"), "claim_id")


def test_issue_scan_reports_near_duplicates(spark):
    names = ["Jonathan Meyer", "Jonathan Meyar", "Sarah Connor", "Sarha Connor", "Elizabeth Warren", "Priya Patel", "David Kim"]
    rows = [(f"P{i:04}", n, "Springfield") for i, n in enumerate([*names, names[0], None, ""])]
    df = spark.createDataFrame(rows, "patient_id string, patient_name string, city string")
    got = {r.issue: r for r in scan_issues(df).collect()}
    want = sum(
        a != b and "" not in (a, b) and max(1 - edit_distance(a, b) / max(len(a), len(b)), _jaro_winkler(a, b)) > 0.85
        for a, b in itertools.combinations([r[1] for r in rows if r[1] is not None], 2)
    )
    near = got["fuzzy_duplicates"]
    assert (near.column, near["count"], near.pct, near.fixes) == ("patient_name", want, None, []) and want >= 3
    assert set(got) == {"fuzzy_duplicates", "nulls"}
    # nothing to report: identifiers only, equal values only, no rows
    assert scan_issues(df.select("patient_id")).isEmpty()
    assert scan_issues(df.select("patient_id", "city")).isEmpty()
    assert scan_issues(df.limit(0)).isEmpty()
    assert spelling_column(df.select("city", "patient_name")) == "city" and spelling_column(df.select("patient_id")) is None


def test_tail_probabilities():
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert chi_square_tail(15.50731306, 8) == pytest.approx(0.05, abs=1e-7)
    assert chi_square_tail(0.5, 3) == pytest.approx(0.918891, abs=1e-6)


def test_results_do_not_depend_on_partitioning(spark):
    from plumbline.operators.stats import bootstrap_mean
    from plumbline.operators.windows import step_anomalies
    from plumbline.plans.layers import table_digest

    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    other = d.repartition(7)
    assert d.agg(table_digest(d).alias("x")).first() == other.agg(table_digest(other).alias("x")).first()
    key = lambda r: r.key
    assert sorted(step_anomalies(d, "value", "ts", "event_id").collect(), key=key) == sorted(step_anomalies(other, "value", "ts", "event_id").collect(), key=key)
    a, b = bootstrap_mean(d, "value", "event_id").first(), bootstrap_mean(other, "value", "event_id").first()
    assert a.low == pytest.approx(b.low) and a.high == pytest.approx(b.high)
    mean = d.agg(F.avg("value")).first()[0]
    assert a.low < mean < a.high


def test_neighbours_come_from_all_rows(spark):
    """5,000 rows, above the former sample: every score against all pairs, with gaps, copies and a rare category."""
    import numpy as np

    from plumbline.operators.anomaly import gower_knn

    rng, n = np.random.default_rng(4), 5000
    a, b = rng.normal(size=n), rng.exponential(size=n)
    c, e = rng.choice(["x", "y", "z", None], n, p=[0.5, 0.3, 0.1, 0.1]), np.array([f"u{i}" for i in rng.integers(0, 60, n)], dtype=object)
    a[:12], b[:12], c[:12], e[:12] = 3.0 + np.arange(12) / 1e4, 4.0, "rare", "u1"
    a[100:400], b[100:400], c[100:400], e[100:400] = a[100], b[100], "x", "u2"
    a[rng.choice(np.arange(400, n), 60, False)] = np.nan
    rows = [(i, None if np.isnan(a[i]) else float(a[i]), float(b[i]), c[i], e[i]) for i in range(n)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c string, e string")
    got = {r.key: r for r in gower_knn(d, "id", ["a", "b"], ["c", "e"]).collect()}
    assert len(got) == n
    for i in [*range(12), 150, *rng.integers(400, n, 200).tolist(), *np.flatnonzero(np.isnan(a))[:20].tolist()]:
        terms = [np.nan_to_num(np.abs(x - x[i]) / np.ptp(x[~np.isnan(x)]), nan=1.0) for x in (a, b)]
        terms += [np.array([0.0 if v is not None and v == x[i] else 1.0 for v in x]) for x in (c, e)]
        dist = np.mean(terms, axis=0)
        dist[i] = np.inf
        near = np.lexsort((*terms[::-1], dist))[:10]
        share = np.array(terms)[:, near].sum(axis=1)
        assert got[i].raw_score == pytest.approx(dist[near].mean(), abs=1e-12)
        assert [got[i].contributions[f] for f in "abce"] == pytest.approx(list(share / max(share.sum(), 1e-12)), abs=2e-4)
    assert got[3].raw_score < 1e-3  # a small dense cluster is not isolated


def test_bootstrap_draws_a_weight_per_row(spark):
    """Beyond 2,000 rows too: one resample's count is a sum of Poisson(1) weights of single rows."""
    import numpy as np

    from plumbline.operators.stats import _draws, bootstrap_mean

    d = spark.range(6000).select("id", (F.col("id") % 97).cast("double").alias("v"))
    h = np.array([r.h for r in d.select(F.xxhash64("id", F.lit(12)).alias("h")).collect()]).view(np.uint64)
    w = np.array([_draws(h, b) for b in range(1, 501)])
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert [np.mean(w == i) for i in range(4)] == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=0.002)
    means = (w @ (np.arange(6000) % 97)) / w.sum(axis=1)
    r = bootstrap_mean(d, "v", "id").first()
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_run_all_reaches_every_layer(spark):
    """Defects that only the table-level layers see show up in the findings."""
    from plumbline.operators.drift import snapshot
    from plumbline.plans.profile import fingerprint
    from plumbline.plans.validate import History, Story, validate

    rows = [(i, i % 50, "F" if i % 2 else "M", None if i % 2 and i % 10 < 6 else 1.0 + i % 7, 20.0 if i % 2 else 10.0, "denied" if i % 3 == 0 else "paid", "470", "E11", ("58260", "58720")[i // 50 % 2], 1) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, patient_id long, sex string, score double, cost double, claim_status string, drg string, icd string, cpt string, day int").withColumn("day", F.lit("2020-01-01").cast("date"))
    old = d.limit(100).withColumn("score", F.lit(100.0) + F.col("id"))
    runs = spark.createDataFrame([("t", 1, 100), ("t", 2, 400)], "table string, run_id int, rows long")
    history = History("another digest", {("score", "cost"): 0.99}, runs, fingerprint(old), snapshot(old, "old"))
    told = spark.createDataFrame([(1, "there were 12345 claims")], "k int, said string")
    f = validate(
        d, "id", as_of=F.lit("2025-01-01").cast("date"), numbers=["score", "cost"], refs={"patient_id": (spark.range(40).toDF("pid"), "pid")}, history=history,
        story=Story(told, "k", "said", spark.createDataFrame([(1.0,)], "x double"), "x"),
    ).collect()
    bad = {r.layer for r in f if r.status in ("warn", "fail")}
    assert {"schema", "correlation", "freshness", "denial_radar", "drg_icd", "code_conflict", "missingness", "equity", "foreign_key", "drift", "snapshot_drift", "row_counts", "stated_numbers"} <= bad
    seen = {r.layer: r.status for r in f}
    assert seen["reproducibility"] == "pass" and seen["confidence"] in ("pass", "warn", "fail")
    assert {(r["columns"][0], r.detail) for r in f if r.layer == "two_paths"} == {(c, n) for c in ("sex", "claim_status", "drg", "icd", "cpt") for n in ("score", "cost")}
    assert {r.status for r in validate(d.select("id", "sex"), "id").collect() if r.layer == "foreign_key"} == {"idle"}


def test_drivers_of_many_values(spark):
    """60 sites explain the gaps; a column of one value per row does not."""
    from plumbline.plans.layers import bias_preflight, missingness_drivers, missingness_ratio

    rows = [(f"s{i % 60}", f"u{i}", None if i % 60 < 6 else 1.0) for i in range(3000)]
    d = spark.createDataFrame(rows, "site string, note string, score double")
    r = missingness_drivers(d, ["score"]).first()
    assert (r.classification, r.driver, r.effect) == ("MAR", "site", 1.0)
    assert missingness_ratio(d, ["score"]).first().driver == "site"
    odd = spark.createDataFrame([(f"v{i}" if i < 40 else "most",) for i in range(400)], "c string")
    assert [(r.column, r.value) for r in bias_preflight(odd).where("kind = 'class_imbalance'").collect()] == [("c", 0.9)]
    from plumbline.operators.anomaly import peer_group_column

    pairs = spark.createDataFrame([(f"p{i // 3}",) for i in range(120)], "p string")  # 40 peers groups among 120 rows
    assert peer_group_column(pairs, ["p"]) == "p"


def test_near_descriptions_lose_no_pair(spark):
    """Against all pairs, other endings included."""
    import random

    from plumbline.functions.text import bigram_dice
    from plumbline.operators.aggregates import near_descriptions

    rng = random.Random(2)
    words = ["share of orders returned within thirty days", "average basket size of new customers", "aaaaaaaaaaaaaaaaaaaab", "net revenue per active member"]
    texts = ["share of orders returned (net)", "share of orders returned (nett)", "", " ", "x", "X"]
    for w in words * 20:
        cut = list(w)
        for _ in range(rng.randrange(3)):
            cut[rng.randrange(len(cut))] = rng.choice("abcxyz ")
        texts.append("".join(cut) + rng.choice(["", "s", "!"]))
    d = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "n int, w string")
    p = d.toDF("a", "wa").crossJoin(d.toDF("b", "wb")).where("a < b")
    want = {(r.a, r.b) for r in p.where(bigram_dice(F.col("wa"), F.col("wb")) >= 0.9).collect()}
    got = [(r.a, r.b) for r in near_descriptions(d, "n", "w").collect()]
    assert (0, 1) in want and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("copies", [1, 8])
def test_neighbour_tree_of_many_levels(spark, monkeypatch, copies):
    """Small boxes, so that the tree has several levels: nothing but the top at the driver, answers as by all pairs."""
    from plumbline.operators import anomaly

    for name, v in (("TILE", 16), ("FAN", 1), ("TOP", 2)):
        monkeypatch.setattr(anomaly, name, v)
    rng, n = np.random.default_rng(5), 400 * copies
    # clusters far apart, the same number of rows in each; more rows, more clusters
    at = rng.integers(0, 4 * copies, n)
    a, b, c = at * 10.0 + rng.normal(size=n) / 10, at * -7.0 + rng.normal(size=n) / 10, np.array([f"k{i % 3}" for i in at], dtype=object)
    a[:3], c[5:9] = np.nan, None
    d = spark.createDataFrame([(i, None if np.isnan(a[i]) else float(a[i]), float(b[i]), c[i]) for i in range(n)], "id long, a double, b double, c string")
    pairs = spark.sparkContext.accumulator(0)
    got = {r.key: r.raw_score for r in anomaly.gower_knn(d, "id", ["a", "b"], ["c"], 5, pairs).collect()}
    terms = [np.nan_to_num(np.abs(x[:, None] - x[None, :]) / np.ptp(x[~np.isnan(x)]), nan=1.0) for x in (a, b)]
    terms.append(np.array([[0.0 if v is not None and v == u else 1.0 for v in c] for u in c]))
    dist = np.mean(terms, axis=0)
    np.fill_diagonal(dist, np.inf)
    want = np.sort(dist, axis=1)[:, :5].mean(axis=1)
    assert [got[i] for i in range(n)] == pytest.approx(list(want), abs=1e-12)
    # pairs compared grow with the rows, not with their square
    assert pairs.value < 300 * n


def test_neighbours_of_one_kind_of_column(spark):
    from plumbline.operators.anomaly import gower_knn

    d = spark.createDataFrame([(i, float(i % 4), "xy"[i % 2]) for i in range(9)], "id long, a double, c string")
    for nums, cats in ((["a"], []), ([], ["c"])):
        rows = d.collect()
        for r in gower_knn(d, "id", nums, cats, 3).collect():
            me = rows[r.key]
            far = sorted(abs(o.a - me.a) / 3 if nums else float(o.c != me.c) for o in rows if o.id != me.id)
            assert r.raw_score == pytest.approx(sum(far[:3]) / 3)
    assert gower_knn(d.limit(0), "id", ["a"], ["c"]).isEmpty()
    assert gower_knn(d.limit(1), "id", ["a"], ["c"]).first().raw_score is None
