"""The pipeline against a plain version of its stages, and the queries against their SQL."""
from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from plumbline.llm import queries
from tests import oracle

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(ROOT)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    cols = sorted((df := queries.QUERIES[name](spark, ROOT)).columns)
    got = sorted((tuple(oracle.norm(r[c]) for c in cols) for r in df.collect()), key=oracle.sort_key)
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(oracle.norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=oracle.sort_key)
    assert len(got) == len(want) and all(oracle.close(a, b) for g, w in zip(got, want) for a, b in zip(g, w))


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    known = dict((d, (q, t)) for d, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{root}/labels.parquet'").fetchall())
    quality = [(r.predicted, known[r.doc_id][0]) for r in queries.QUERIES["op4_quality"](spark, root).collect() if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in quality) >= 0.95 * len(quality)
    toxic = [(r.predicted, known[r.doc_id][1]) for r in queries.QUERIES["op7_toxicity"](spark, root).collect() if r.held_out and r.doc_id in known]
    assert sum(p and not y for p, y in toxic) <= 0.02 * len(toxic)


def test_pages_by_markup(spark):
    got = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 250 and sum(r.lang == r.declared for r in got) >= 0.9 * len(got)


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from plumbline.llm import quality
    from tests.llm.test_edges import plain_links, plain_targets

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    good = {r.doc_id for r in quality.scored(docs, labels).collect() if r.score >= 0.3}
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect() if r.doc_id in good]
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip("\t\n\x0b\x0c\r "))
    holders: dict[str, set] = {}
    for d, t, _ in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    keep = lambda d, x: len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d
    rows = [(d, "\n".join(x for x in t.split("\n") if keep(d, x)), s) for d, t, s in rows]
    links = plain_links(rows)
    rows = [r for i, r in enumerate(rows) if links[i][1] == r[0]]
    got = pipeline.run(spark, ROOT).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {r[0] for r in rows}
    words = {d: len(t.encode().split()) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    size, taken, longest = Counter(), Counter(), Counter()
    for d, n in words.items():
        size[source[d]] += n
        longest[source[d]] = max(longest[source[d]], n)
    for r in got:
        taken[source[r.doc_id]] += words[r.doc_id]
    target = plain_targets(size)
    # whole documents: the last of a source is taken or left out
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in size)
    assert max(Counter(r.doc_id for r in got).values()) == 2
