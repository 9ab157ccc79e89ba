"""Table functions and user code over tables."""
from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from plumbline.functions.tables import map_frames, register_table_functions

T0 = dt.datetime(2024, 1, 1)


def test_session_numbers_at_the_edges(spark):
    """Null keys and times, ties, an exact gap, names with spaces and dots, an empty table."""
    register_table_functions(spark)
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    rows = [(1, "a", 0), (2, "a", 0), (3, "a", 59), (4, "a", 119), (5, "a", None), (6, None, 5), (7, None, 500), (8, "b", 3)]
    d = spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "id long, `a key` string, `t.s` timestamp")
    call = "SELECT * FROM number_sessions(TABLE(SELECT * FROM {d}), 'a key', 'T.S', 60)"
    out = spark.sql(call, d=d)
    assert out.columns == [*d.columns, "session"]
    assert {r.id: r.session for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: None, 6: 1, 7: 2, 8: 1}
    assert spark.sql(call, d=d.limit(0)).isEmpty()
    for wrong in ("'a key', 'nothing', 60", "'a key', 't.s', 0", "CAST(NULL AS STRING), 't.s', 60"):
        with pytest.raises(AnalysisException):
            spark.sql("SELECT * FROM number_sessions(TABLE(SELECT * FROM {d}), " + wrong + ")", d=d)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM number_sessions(TABLE(SELECT *, 1 AS session FROM {d}), 'a key', 't.s', 60)", d=d)


def test_user_code_sees_a_hot_key_in_batches(spark):
    d = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 400)) as `a.k`")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        def sizes(frames):
            key, seen = None, []
            for f in frames:
                assert f["a.k"].nunique() == 1
                key = f["a.k"].iloc[0]
                seen.append(len(f))
            yield pd.DataFrame({"key": pd.Series([key], dtype=object), "n": [sum(seen)], "most": [max(seen)]})

        got = {r.key: r for r in map_frames(d, sizes, "key string, n long, most long", ["a.k"]).collect()}
        assert sum(r.n for r in got.values()) == 5000 and got["hot"].n == 1667
        assert got["hot"].most <= 100
        assert map_frames(d.limit(0), sizes, "key string, n long, most long", ["a.k"]).isEmpty()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_user_code_over_partitions(spark):
    def double(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["an.id"] * 2})

    assert map_frames(spark.range(1000).toDF("an.id"), double, "id long").selectExpr("sum(id)").first()[0] == 999_000
