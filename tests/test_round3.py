"""Work that must not grow faster than the tables, and the same results by plainer means."""
from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from plumbline.operators import fuzzy as Z
from plumbline.session import ensure_checkpoint_dir


def written_bytes(spark, job):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(folder) for f in fs)
    before = size()
    return job(), size() - before


def test_convergence_writes_less_than_its_records(spark):
    """Only links between keys are written, not the records and not one edge for each of them."""
    a = spark.range(20000).selectExpr("id as claim_id", "repeat('x', 300) as note")
    b = spark.range(20000).selectExpr("id as claim_id", "if(id % 500 = 0, concat('p', id), null) as person", "repeat('y', 300) as note")
    c = spark.range(20000).selectExpr("concat('p', id) as person", "'hot' as claim_id")
    sources = [Z.Source("A", a, (("claim_id",),), 0.9), Z.Source("B", b, (("claim_id",), ("person",))), Z.Source("C", c, (("person",),), 0.65)]
    row, size = written_bytes(spark, lambda: Z.convergence_summary(Z.converge(sources)[0]).first())
    assert row.joined_clusters == 20000 and row.auto_resolved == 20000 and size < 500_000


def test_convergence_equals_a_plain_version(spark):
    """Values that repeat within a source, ties of trust, blank keys, hot keys, no keys."""
    rnd = random.Random(3)
    values = ["1", "1.0", "2", " a", "A", "b", "", None]
    row = lambda i: (rnd.choice([None, "", *map(str, range(9))]), rnd.choice([None, *map(str, range(200, 209))]), rnd.choice(values))
    trust = {"A": 0.9, "B": 0.7, "C": 0.7}
    rows = {n: [row(i) for i in range(9)] for n in trust}
    df = {n: spark.createDataFrame(r, "k string, p string, v string") for n, r in rows.items()}
    keys = {"A": (("k",),), "B": (("k",), ("p",)), "C": (("p",),)}
    clusters, found = Z.converge([Z.Source(n, df[n], keys[n], trust[n]) for n in trust])

    norm = lambda v: None if v is None or not v.strip() else str(float(v)) if v.strip().replace(".", "").isdigit() else v.strip().lower()
    items = [(n, dict(zip("kpv", r))) for n in trust for r in sorted(set(rows[n]), key=str)]
    group = list(range(len(items)))
    hold = [{(key, norm(r[key[0]])) for key in keys[n] if norm(r[key[0]])} for n, r in items]
    for i in range(len(items)):
        for j in range(i):
            if hold[i] & hold[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want, settled = [], []
    for g in set(group):
        members = [items[i] for i in range(len(items)) if group[i] == g]
        flags = []
        for c in "kpv":
            best = {}
            for n, r in members:
                if norm(r[c]):
                    best[norm(r[c])] = max(best.get(norm(r[c]), (0, "", "")), (trust[n], n, r[c]))
            if len(best) > 1:
                top = max((x[0], str(k), *x[1:]) for k, x in best.items())
                second = max(x[0] for k, x in best.items() if k != top[1])
                flags.append(top[0] - second >= 0.15 - 1e-12)
                settled.append((c, flags[-1], top[3] if flags[-1] else None, top[2] if flags[-1] else None, round(top[0] - second, 6)))
        want.append((sorted({n for n, _ in members}), bool(flags), not all(flags)))
    assert sorted((r.sources, r.has_conflict, r.escalated) for r in clusters.collect()) == sorted(want)
    got = [(r.column, r.resolved, r.value, r.source, r.margin) for r in found.collect()]
    assert sorted(got, key=str) == sorted(settled, key=str) and any(x[1] for x in got) and not all(x[1] for x in got)


def test_chains_at_block_borders(spark, monkeypatch):
    """Against a plain check: forks, gaps, null and odd hashes, chains over several blocks; only hashes are shuffled."""
    from plumbline.operators import audit as H

    monkeypatch.setattr(H, "CHAIN_BLOCK", 4)
    rnd, rows = random.Random(5), []
    for d in range(40):
        parent = H.GENESIS
        for step in range(rnd.choice([1, 4, 5, 13])):
            own = sha(parent, "op", f"s{step}", "")
            odd = rnd.random()
            row = [str(d), step, "op", f"s{step}", None, parent, own]
            if odd < 0.02:
                row[3] = "changed"
            elif odd < 0.04:
                row[5], row[6] = "no digest", sha("no digest", "op", f"s{step}", "")
            elif odd < 0.06:
                row[6] = None
            elif odd < 0.08:
                other = sha("f" * 64, "op", f"s{step}", "")
                rows.append([str(d), step, "op", f"s{step}", None, "f" * 64, other])
            if odd < 0.9 or step == 0 or odd > 0.92:
                rows.append(row)
            parent = own
    log = spark.createDataFrame(rows, "dataset string, step long, op string, description string, content string, parent_hash string, hash string")
    want = {}
    for d in {r[0] for r in rows}:
        mine, bad = [r for r in rows if r[0] == d], []
        for r in mine:
            prev = max((x[6] for x in mine if x[1] == r[1] - 1 and x[6]), default=H.GENESIS)
            linked, honest = r[5] == prev, None if r[6] is None else r[6] == sha(r[5], r[2], r[3], "")
            if not linked or honest is False:
                bad.append(r[1])
        want[d] = (len(mine), min(bad, default=None), not bad)
    out = H.verify_chains(log)
    assert {r.dataset: (r.steps, r.broken_at, r.valid) for r in out.collect()} == want
    assert any(v for _, _, v in want.values()) and any(b and b > 4 for _, b, _ in want.values())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def sha(*parts):
    import hashlib

    return hashlib.sha256("\u0001".join(parts).encode()).hexdigest()


def test_claims_are_sorted_once_on_each_side(spark):
    """The leader comes along through the grouping: one join, and no side read a third time."""
    rows = [("e1", "f", "X", "a", 0.6), ("e1", "f", "X", "a", 0.6), ("e1", "f", "Y", "b", 0.62), ("e2", "f", "X", "a", None), ("e2", "f", "Y", "b", 0.62), ("e3", "f", "X", "a", 0.2), ("e4", "f", "X", "c", 0.5), ("e4", "f", "Y", "c", 0.5)]
    c = spark.createDataFrame(rows, "entity string, field string, value string, source string, confidence double")
    out = Z.reconcile_claims(c, {"a": 0.9, "b": 0.5})
    got = {r.entity: (r.decided_by, r.source, r.value) for r in out.collect()}
    assert got == {"e1": ("source trust", "a", "X"), "e2": ("source trust", "a", "X"), "e3": ("single claim", "a", "X"), "e4": ("unresolved", None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_reproducibility_has_partitions_enough(spark, monkeypatch):
    """No run deals the rows to fewer tasks than the table is read by."""
    from plumbline.plans import layers as L

    df, seen = spark.range(4000).repartition(29).withColumn("v", F.col("id") % 7), []
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: (seen.append(n), deal(self, n, *c))[1])
    r = L.reproducibility(df).first()
    assert (r.distinct_digests, r.runs, r.status) == (1, 3, "pass")
    assert len(set(seen)) == 2 and min(seen) >= 29


def test_sums_in_intervals_equal_the_pairs(spark):
    """Ties at both ends, hot places, nulls, empty and backward intervals; no pairs are formed."""
    from plumbline.operators import ordered_joins as O

    p = spark.range(3000).selectExpr("if(id % 50 = 0, null, if(id % 3 = 0, 5.0, cast(id % 40 as double) / 2 - 3)) as at", "if(id % 7 = 0, null, id) as v", "cast(id % 5 as int) as w")
    i = spark.range(300).selectExpr("id as k", "if(id % 40 = 0, null, id % 30 / 2 - 4) as a", "if(id % 41 = 0, -99, id % 30 / 2 - 4 + id % 4 * 2) as b")
    met = O.points_in_intervals(p, i, "at", "a", "b").groupBy("k").agg(F.count(F.lit(1)).alias("points"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    got = O.sums_in_intervals(p, i, "at", "a", "b", "k", ["v", "w"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, met.collect())) and met.count() > 200
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert O.sums_in_intervals(p.limit(0), i, "at", "a", "b", "k", ["v"]).isEmpty()


def test_user_code_merges_a_hot_key(spark):
    """Rows of a key are seen where they lie; null keys and keys beyond doubles stay apart."""
    import pandas as pd

    from plumbline.functions.tables import map_frames

    d = spark.range(0, 6000, 1, 6).selectExpr("if(id % 10 = 0, null, if(id % 2 = 0, 9007199254740993, 9007199254740992)) as `a.k`", "id")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")

    def told(frames):
        for f in frames:
            assert len(f) <= 100
            yield pd.DataFrame({"odd": [int(f["id"].iloc[0] % 2)], "n": [len(f)], "calls": [1], "ten": [int((f["id"] % 10 == 0).all())]})

    def merged(frames):
        f = pd.concat(list(frames))
        yield pd.DataFrame({"odd": f["odd"][:1], "n": [f["n"].sum()], "calls": [f["calls"].sum()], "ten": f["ten"][:1]})

    try:
        got = {(r.odd, r.ten): (r.n, r.calls) for r in map_frames(d, told, "odd long, n long, calls long, ten long", ["a.k"], merged).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {(0, 1): (600, 60), (0, 0): (2400, 60), (1, 0): (3000, 60)}


def test_small_cells_are_compared_together(spark):
    """Pairs of many cells at once; vectors of two lengths, copies, tiles and cells of every size against brute force."""
    import numpy as np

    from plumbline.llm import embedding_dedup as E

    assert [x.tolist() for x in E.pairs_within(np.array([1, 3, 2]))] == [[1, 1, 2, 4], [2, 3, 3, 5]]
    rng = np.random.default_rng(4)
    at = {d: rng.normal(size=(40, d)) for d in (8, 12)}
    rows = []
    for i in range(700):
        d = 8 if i % 3 else 12
        v = at[d][0 if i % 4 == 0 else i % 40] + rng.normal(size=d) * (0 if i % 11 == 0 else 0.12)
        rows.append((i, [float(x) for x in v], i % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    old = E.TILE, E.SMALL, E.SLICE
    got = {}
    try:
        for E.TILE, E.SMALL, E.SLICE in ((512, 24, 1 << 19), (16, 4, 1 << 11), (16, 0, 1 << 11)):
            out = E.near_vectors(df, tables=40, bits=4).collect()
            got[E.SMALL] = {r.id: (r.n_links, r.component_id) for r in out}
    finally:
        E.TILE, E.SMALL, E.SLICE = old
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = {i: [j for j in range(700) if j != i and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93] for i in range(700)}
    least = {}
    for i in range(700):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] if j not in seen and not seen.add(j)]
        least[i] = min(seen)
    want = {i: (len(near[i]), least[i]) for i in range(700)}
    assert got[24] == want and got[4] == want and got[0] == want
