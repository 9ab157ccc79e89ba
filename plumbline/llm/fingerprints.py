"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text. A chunk ends where the hash has its top bits at zero:
many bits up to the normal size, fewer beyond it, so chunk sizes stay near normal. Boundaries depend
on nearby bytes only, so an insertion shifts chunks without changing them. The fingerprint is the
set of chunk digests with their lengths; likeness is the length that the shorter text shares.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import cut_index
from plumbline.llm.common import text_of, text_slices
from plumbline.model import col

SHORTEST, NORMAL, LONGEST = 16, 48, 192  # bytes of a chunk
STRICT, LOOSE = 7, 4  # bits at zero before and after the normal size
GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
DIGEST = (1 << 48) - 1


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At every byte, the sum of the gears of the last 32 bytes, each shifted by its distance."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = gear_hash(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0].tolist()
    loose = loose.tolist()
    strict.append(n)
    loose.append(n)
    ends, start = [], 0
    while n - start > SHORTEST:
        at = strict[bisect_left(strict, start + SHORTEST - 1)]
        if at >= start + NORMAL - 1:
            at = min(loose[bisect_left(loose, start + NORMAL - 1)], start + LONGEST - 1)
        start = min(at + 1, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[int, int]:
    """Digest to length of the text's distinct chunks, lengths of equal chunks added up."""
    data = text.encode()
    out: dict[int, int] = {}
    start = 0
    for end in boundaries(data):
        d = xxhash.xxh3_64_intdigest(data[start:end]) & DIGEST
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def written_out(chunk_set: dict[int, int]) -> str:
    """The fingerprint as text: digests in hexadecimal with lengths, in order of digest."""
    return " ".join([f"{d:012x}:{chunk_set[d]}" for d in sorted(chunk_set)])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The length of chunks in both, by that of the shorter text; 1 for two empty texts, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    shared = sum(min(n, b[d]) for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def fingerprints(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fingerprint`` of every text. Null and empty texts have the empty fingerprint."""
    kept = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[col(k).alias(a) for k, a in zip(keep, kept)], text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = pa.array([written_out(chunks(t.as_py())) for t in part.column("text")], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(a) for a in kept], found], names=[*kept, "fingerprint"])

    types = "".join(f"{a} {source.schema[a].dataType.simpleString()}, " for a in kept)
    out = source.mapInArrow(run, types + "fingerprint string")
    return out.select(*[F.col(a).alias(k) for k, a in zip(keep, kept)], "fingerprint")


def placed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows by range bucket in descending order of id; the first of a bucket also goes, as ``ahead``, to the bucket before.

    Cuts are quantiles of the id, some buckets for each shuffle partition; only the cuts and the
    first id of each bucket come to the driver. Rows with one id are ordered by a digest of the text.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(col(key).cast("long").alias("doc"))
    probs = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = sorted(set(ids.agg(F.percentile_approx("doc", probs, 40 * parts)).first()[0] or []))
    last = 2 * len(cuts) + 1

    def bucket(doc: Column) -> Column:
        return F.when(doc.isNull(), last + 1).otherwise(F.lit(last) - cut_index(doc, cuts)).cast("int")

    heads = {r["b"]: r["head"] for r in ids.groupBy(bucket(F.col("doc")).alias("b")).agg(F.max("doc").alias("head")).collect()}  # a row per bucket
    filled = sorted(heads)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    head = F.array(*[F.lit(heads.get(b)).cast("bigint") for b in range(last + 2)])
    earlier = F.array(*[F.lit(before.get(b)).cast("int") for b in range(last + 2)])
    rows = df.select(col(key).cast("long").alias("doc"), text_of(text).alias("text")).withColumn("b", bucket(F.col("doc")))
    own = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.get(earlier, F.col("b")).alias("bucket"), F.lit(True).alias("ahead"))
    places = F.when(F.col("doc").eqNullSafe(F.get(head, F.col("b"))), F.array(own, ahead)).otherwise(F.array(own))
    return rows.select(F.explode(places).alias("p"), "doc", "text").select("p.bucket", "p.ahead", "doc", "text"), parts


def edited_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text are.

    The next document is that with the next smaller id, for the last the first; ids that are null
    come last, rows with one id in order of a digest of their text. Edited: the last third of the
    code points, rounded down, replaced by the first as many, or all, of the next text. A null text
    counts as empty. Columns: doc, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Texts are shuffled once, by range of id.
    """
    rows, parts = placed(df, key, text)
    order = ["bucket", "ahead", F.col("doc").desc_nulls_last(), F.xxhash64("text"), "text"]
    spread = rows.repartition(parts, "bucket").sortWithinPartitions(*order)
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, id, text, chunks of the row whose next is awaited
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                out: list[tuple] = []
                for bucket, ahead, doc, body in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if last is None and ahead or last is not None and ahead and last[0] != bucket:
                        continue  # more rows with the id of the one ahead
                    own = chunks(body)
                    if last is not None and last[0] == bucket:
                        _, last_doc, last_body, last_chunks = last
                        third = len(last_body) // 3
                        edited = last_body[: len(last_body) - third] + body[:third]
                        edited_chunks = chunks(edited)
                        out.append(
                            (
                                last_doc,
                                len(last_body),
                                hashlib.sha256(edited.encode()).hexdigest(),
                                written_out(last_chunks),
                                written_out(edited_chunks),
                                likeness(last_chunks, edited_chunks),
                                likeness(last_chunks, own),
                            )
                        )
                    last = None if ahead else (bucket, doc, body, own)
                columns = list(zip(*out)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return spread.mapInArrow(run, schema)
