"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import col
from plumbline.session import written  # noqa: F401  (shared by the operators of this folder)

SLICE_BYTES = 4 << 20


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def others(names: Iterable[str], results: Iterable[str]) -> list[str]:
    """The names that are not those of result columns, case aside: a result stands for a column of its name."""
    own = {r.lower() for r in results}
    return [n for n in names if n.lower() not in own]


def returned(out: Iterator) -> Iterator:
    """``out``, and at its end the memory that a task no longer needs goes back to the system.

    Workers are used again by later tasks, and wait beside the JVM in the meantime.
    """
    yield from out
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def in_training(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from: crc32 of its id as text is not 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def array_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Texts in runs of about ``limit`` bytes."""
    for part in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", limit):
        yield part.column(0)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about ``limit`` bytes of text, one row at least, so that memory stays bounded."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])
