"""Operators and stages on tables whose extra columns have the names that the operators use themselves."""
from __future__ import annotations

import os

import pytest

import corpus_pipeline as pipeline
from plumbline.llm import embedding_dedup, fingerprints, jaccard_join, language_id, line_dedup, mixing, quality, secret_scan, toxicity
from tests.llm.test_edges import rows

# names that operators work with, and names of their results
NAMES = (
    "_row _doc _keep _dropped _own _n_lines _n_dropped _pos _line _n _h1 _h2 _range _key _r row doc id cls grp prefix splits n items kept component_id n_shingles "
    "size source_size target taken copies copy due _due _copy _order _source k0 k1 score _score passages n_words label _evidence start end kind digest owner repository spans base m0 "
    "signs links bucket tile embedding_x v w component chunk data bytes sha1 record key total origin salt n_a n_b groups times"
).split()
CLASH = [f"clash {n}" for n in NAMES]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(d, t, g, s, None, *CLASH) for d, t, g, s, *_ in rows()]
    return spark.createDataFrame(data, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{n}` string" for n in NAMES]])).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0, "x"), (7, 0, 1, "x"), (9, 1, 0, "x"), (4, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")


def unhurt(df) -> None:
    """Extra columns hold what they held."""
    for r in df.select(*[f"`{n}`" for n in NAMES if n in df.columns]).collect():
        assert list(r) == [f"clash {n}" for n in r.asDict()]


def test_kept_columns(docs, labels):
    n = docs.count()
    found = quality.scored(docs, labels, keep=tuple(docs.columns))
    assert found.count() == n and dict(found.dtypes)["score"] == "double"
    unhurt(found.drop("score"))
    found = toxicity.scored(docs, labels, keep=tuple(docs.columns))
    assert found.count() == n and dict(found.dtypes)["score"] == "double"
    unhurt(found.drop("score", "passages"))
    found = mixing.mix(docs, keep=tuple(docs.columns))
    results = ("size", "source_size", "target", "taken", "copies", "due")
    assert found.count() == n and dict(found.dtypes)["taken"] == "bigint"
    unhurt(found.drop(*results))
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert found.count() == n and dict(found.dtypes)["_n_dropped"] == "bigint"
    unhurt(found.drop("_n_lines", "_n_dropped"))


def test_other_operators(spark, docs):
    n = docs.count()
    assert secret_scan.scan(docs).count() == n
    assert fingerprints.edited_neighbours(docs).count() == n
    assert jaccard_join.similar_sets(docs).count() == n
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 1, *CLASH), (2, [1.0, 2.0], 1, *CLASH)], ", ".join(["vec_id long, embedding array<double>, lab int", *[f"`{x}` string" for x in NAMES]]))
    assert [r.n_links for r in embedding_dedup.near_vectors(vectors, label="lab").collect()] == [1, 1]
    pages = spark.createDataFrame([(1, "http://a.de", "<p>und</p>", *CLASH)], ", ".join(["page_id long, url string, html string", *[f"`{x}` string" for x in NAMES]]))
    assert language_id.identify(pages, docs).count() == 1


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_stages(spark, docs, labels, tmp_path, stage):
    """Nulls, empty and long texts, repeated rows, clashing names; then an empty table."""
    root = str(tmp_path)
    labels.write.parquet(os.path.join(root, "labels.parquet"))
    found = stage(spark, docs, root)
    assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
    unhurt(found)
    got = sorted((r.doc_id or 0) for r in found.collect())
    ids = sorted((r[0] or 0) for r in rows())
    if stage is pipeline.drop_lines:
        assert got == ids
    elif stage is pipeline.drop_near_copies:
        assert set(got) >= {1, 2, 3, 4, 6, 9, 11, 12, 15} and got.count(12) == 1 and 10 not in got and 5 not in got
    elif stage is pipeline.mix_sources:
        assert not {1, 2, 3} & set(got) and set(got) <= set(ids)
    else:
        assert set(got) <= set(ids) and got.count(12) in (0, 2)
    none = stage(spark, docs.limit(0), root)
    assert none.columns == docs.columns and none.collect() == []


def test_last_stage(spark, docs):
    got = pipeline.encode(spark, docs, "")
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() == docs.count()
    assert {r.n_tokens for r in got.collect() if r.doc_id in (1, 2)} == {0}
    assert pipeline.encode(spark, docs.limit(0), "").collect() == []
