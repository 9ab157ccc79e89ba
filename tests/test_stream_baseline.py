"""Baselines carried from batch to batch: no reread, same findings on replay and after a restart."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.streaming.validator import StreamValidator


def batches(spark):
    """The mean jumps in the third batch, the rows in the fifth, a column changes in the sixth."""
    make = lambda n, shift: spark.range(n).select(F.col("id"), (F.col("id") % 10 + shift).cast("double").alias("v"))
    out = [make(100, 0), make(100, 0), make(100, 50), make(100, 50), make(300, 50)]
    return [*out, make(300, 50).withColumn("more", F.lit(1)), make(0, 0), make(300, 50).withColumn("more", F.lit(1))]


def rows(v):
    return sorted(map(tuple, v.findings().collect()))


def test_only_the_slots_are_read(spark, tmp_path, monkeypatch):
    v = StreamValidator(spark, "s", str(tmp_path / "f"), ["v", "id"])
    data = batches(spark)
    v.process(data[0], 0)
    with monkeypatch.context() as m:
        m.setattr(StreamValidator, "findings", lambda self: pytest.fail("findings were read again"))
        for i, b in enumerate(data[1:], 1):
            v.process(b, i)
    status = {(r.batch_id, r.column): r.status for r in v.findings().collect()}
    assert [status[i, "v"] for i in (0, 1, 2, 3, 4, 5, 7)] == ["pass", "pass", "fail", "pass", "fail", "fail", "pass"]
    assert len(status) == 14 and (6, "v") not in status  # the empty batch gives nothing
    assert sorted(v._held().values()) == [5, 7]


def test_replay_and_restart(spark, tmp_path):
    data = batches(spark)
    whole = StreamValidator(spark, "s", str(tmp_path / "a"), ["v"])
    for i, b in enumerate(data):
        whole.process(b, i)
    again = StreamValidator(spark, "s", str(tmp_path / "b"), ["v"])
    for i, b in enumerate(data):
        again.process(b, i)
        # the batch once more, by a validator that knows only the folder
        again = StreamValidator(spark, "s", str(tmp_path / "b"), ["v"])
        again.process(b, i)
    assert rows(whole) == rows(again)
    again.process(data[2], 2)  # older than both slots: judged against the findings, slots stay
    assert rows(whole) == rows(again) and sorted(again._held().values()) == [5, 7]


def test_half_written_batch(spark, tmp_path, monkeypatch):
    """A batch that ends before its slot is written, or with the slot it overwrites gone, is judged alike when it runs again."""
    data = batches(spark)
    whole, cut = (StreamValidator(spark, "s", str(tmp_path / n), ["v"]) for n in "ab")
    for i in range(3):
        whole.process(data[i], i)
        cut.process(data[i], i)
    monkeypatch.setattr(cut, "_carry", lambda i: None)
    cut.process(data[3], 3)
    cut = StreamValidator(spark, "s", str(tmp_path / "b"), ["v"])
    oldest = min(cut._held(), key=cut._held().get)
    spark.createDataFrame([], cut.findings().schema).write.mode("overwrite").parquet(cut._slot(oldest))
    for i in (3, 4):
        whole.process(data[i], i)
        cut.process(data[i], i)
    assert rows(whole) == rows(cut) and sorted(cut._held().values()) == [3, 4]


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    make = lambda shift: spark.range(50).select((F.col("id") % 10 + shift).cast("double").alias("v")).coalesce(1)
    for shift in (0, 0, 50):
        make(shift).write.mode("append").parquet(str(source))
        v = StreamValidator(spark, "s", str(tmp_path / "out"), ["v"])
        v.start(spark.readStream.schema("v double").parquet(str(source)), log).awaitTermination()
    assert [r.status for r in v.findings().orderBy("batch_id").collect()] == ["pass", "pass", "fail"]
