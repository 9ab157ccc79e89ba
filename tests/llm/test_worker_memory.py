"""What workers keep after a task (pipeline, round 3)."""
from __future__ import annotations

import gc

import pyarrow as pa

from plumbline.llm import bpe
from plumbline.llm.queries import tokenizer_spec


def test_workers_keep_no_codec(spark):
    texts = [(i, f"word{i} and another") for i in range(40)] + [(99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    spec = tokenizer_spec()
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, spec).collect()}
    own = bpe.Codec(spec)
    assert got == {i: own.encode([t or ""])[0] for i, t in texts}

    def kept(batches):
        for batch in batches:
            n = sum(type(x).__name__ == "Codec" for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * batch.num_rows, pa.int64())})

    # the workers of the tasks above are used again
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()} == {0}
