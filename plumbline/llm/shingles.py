"""Word shingles as 64-bit hashes, and a bounded sketch of how often hashed items occur."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from plumbline.llm.common import returned

SIZE = 5
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 14


class WordHashes(dict):
    """64-bit hash of a word, kept for the words a worker meets, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: what bytes.lower and bytes.split do."""
    return text.encode().lower().split()


def scramble(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, known: WordHashes, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a text, sorted; fewer words than ``size`` make one shingle, none make none."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    n = min(size, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * SPREAD + h[i : len(w) - n + 1 + i]
    return np.unique(scramble(total))


def sketch(df: DataFrame, slots_of: Callable[[], Callable[[pa.RecordBatch], Iterator[np.ndarray]]], bits: int) -> np.ndarray:
    """How often each of ``2 ** bits`` slots is hit over the whole of ``df``: a fixed-size array.

    ``slots_of()`` makes, once a task, a function from an Arrow batch to arrays of slots. Tasks
    add up locally and send blocks of counters, which are added up block by block in a stream.
    """
    n_blocks = max(1, (1 << bits) // BLOCK)
    width = (1 << bits) // n_blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = slots_of(), np.zeros(1 << bits, np.int64)
        pending: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for slots in find(batch):
                pending.append(slots)
                held += len(slots)
                if held > 1 << bits:  # adding up costs as much as the counters are many
                    total += np.bincount(np.concatenate(pending), minlength=1 << bits)
                    pending, held = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=1 << bits)
        parts = total.reshape(n_blocks, width)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = total.setdefault(block, np.zeros(width, np.int64))
                own += np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = df.mapInArrow(lambda batches: returned(count(batches)), schema).repartition(min(n_blocks, 64), "block").mapInArrow(add, schema)
    out = np.zeros((n_blocks, width), np.int64)
    for row in parts.toLocalIterator():
        out[row.block] = np.frombuffer(row.counts, np.int64)
    return out.reshape(-1)
