"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, connected components.

Every vector gets one bucket in each table, the signs of its products with that table's
hyperplanes. Vectors that share a bucket are compared by exact cosine, in blocks; a pair that
shares several buckets counts in the first only, so links can be added up without listing pairs.
A bucket of any size is cut into tiles, and every pair of tiles is a block of its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.components import components
from plumbline.model import col

TABLES, BITS = 64, 14
TILE = 512
SMALL = 24  # rows of a cell that is compared together with others
SLICE = 1 << 19  # components of vectors in hand
SEED = 7


def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    """Whole-numbered normal directions, so that products with whole-numbered vectors are exact in any order."""
    return np.rint(np.random.default_rng(SEED).standard_normal((dim, tables * bits)) * 256)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision, without overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(embedding: Column, label: Column) -> Column:
    """A label and a vector that is not zero, with no null or non-finite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def signed_classes(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """Adds ``signs``: the bucket of the vector in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                lists = batch.column("embedding")
                sizes = lists.value_lengths().to_numpy()
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                ends = np.cumsum(sizes)
                signs = np.zeros((len(sizes), tables), np.int16)
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    if dim not in planes:
                        planes[dim] = hyperplanes(dim, tables, bits)
                    v = np.rint(unit(np.stack([flat[ends[i] - dim : ends[i]] for i in at])) * (1 << 20))
                    up = (v @ planes[dim] > 0).reshape(len(at), tables, bits)
                    signs[at] = up @ power
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(signs.reshape(-1)))], names=[*batch.schema.names, "signs"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, types + ", signs array<short>")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of ``n`` by the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that share a cell, of cells of these sizes that lie one after another."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(len(ends)) - 1
    a = np.repeat(np.arange(len(ends)), left)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)


def blocks(cells: DataFrame, least: float) -> DataFrame:
    """Compare the rows of every cell: (cls, links, root) where a link was found.

    Rows come sorted by cell (label, dim, table, bucket, two tiles), so a cell is at most two tiles
    of vectors in memory. Small cells are compared many at a time.
    """
    key = ["label", "dim", "t", "bucket", "tile_lo", "other"]

    def borders(part: pa.RecordBatch) -> np.ndarray:
        """Where a cell begins."""
        new = np.zeros(part.num_rows - 1, bool)
        for c in key:
            x = part.column(c)
            new |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def compared(part: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        """The links of whole cells of vectors of one length."""
        column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
        u = unit(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
        signs = part.column("signs").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        tile, table, n, across = column("tile"), column("t"), column("n"), column("tile_lo") != column("other")
        begin = borders(part)
        sizes = np.diff(np.append(begin, part.num_rows))
        small = sizes <= SMALL
        rows = np.flatnonzero(np.repeat(small, sizes))
        a, b = (rows[x] for x in pairs_within(sizes[small]))
        a, b = (x[~across[a] | (tile[a] != tile[b])] for x in (a, b))
        step, near = max(1, SLICE // dim), np.zeros(len(a), bool)
        for start in range(0, len(a), step):
            s = slice(start, start + step)
            near[s] = np.einsum("ij,ij->i", u[a[s]], u[b[s]]) >= least
        found = [(a[near], b[near])]
        for start, size in zip(begin[~small], sizes[~small]):
            cell = np.arange(start, start + size)
            one = cell[tile[cell] == tile[cell].min()] if across[start] else cell
            two = cell[tile[cell] != tile[cell].min()] if across[start] else cell
            x, y = np.nonzero(u[one] @ u[two].T >= least)
            x, y = one[x], two[y]
            found.append((x, y) if across[start] else (x[x < y], y[x < y]))
        a, b = (np.concatenate(x) for x in zip(*found))
        new = np.ones(len(a), bool)
        for start in range(0, len(a), 20_000):
            s = slice(start, start + 20_000)
            before = np.arange(signs.shape[1]) < table[a[s], None]
            new[s] = ~((signs[a[s]] == signs[b[s]]) & before).any(axis=1)
        a, b = a[new], b[new]
        links = np.bincount(a, n[b], part.num_rows) + np.bincount(b, n[a], part.num_rows)
        root, cls, at = roots(part.num_rows, a, b), column("cls"), np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(links[at].astype(np.int64)), pa.array(cls[root[at]])], names=["cls", "links", "root"])

    def results(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = part.column("dim").to_numpy(zero_copy_only=False)
        lengths = np.unique(dims)
        for dim in lengths:
            yield compared(part if len(lengths) == 1 else part.take(pa.array(np.flatnonzero(dims == dim))), int(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for whole in batches:
            start = 0
            while start < whole.num_rows:
                rows = max(256, SLICE // whole.column("dim")[start].as_py())
                part = whole.slice(start, rows)
                start += rows
                if rest is not None:
                    part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
                last = int(borders(part)[-1])
                if last:
                    yield from results(part.slice(0, last))
                rest = part.slice(last)
        if rest is not None:
            yield from results(rest)

    return cells.mapInArrow(run, "cls long, links long, root long")


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tables: int = TABLES, bits: int = BITS
) -> DataFrame:
    """Per row ``id``, ``n_links``, ``component_id`` and ``kept``.

    Rows link when their labels are equal and the cosine of their vectors is ``least`` or more.
    A pair at cosine c is found with chance 1 - (1 - (1 - acos(c) / pi) ** bits) ** tables: all but
    1 in 130,000 at 0.93, all but 1 in 10 million from 0.94 on. Rows without label or with a vector
    that is null, empty, zero, or holds a null or non-finite component link with nothing; so do
    vectors of different lengths. ``n_links`` counts the other rows linked directly, repeated
    rows included; ``component_id`` is the smallest id reachable, the row's own included; ``kept``
    says whether that is the row's own id. Equal vectors of one label are compared once.

    Use about log2(vectors of the largest label) bits, and tables to go with them.
    """
    rows = df.select(col(key).alias("id"), col(label).alias("label"), col(vector).alias("embedding"))
    same = F.xxhash64(F.col("label").cast("string"), "embedding")
    ok = rows.where(usable(F.col("embedding"), F.col("label"))).withColumn("cls", same)
    classes = ok.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    signs = written(signed_classes(classes.withColumn("dim", F.size("embedding")), tables, bits), "signs")
    bucket = ["label", "dim", "t", "bucket"]
    entries = signs.select("cls", "label", "dim", F.posexplode("signs").alias("t", "bucket"))
    full = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    shared = entries.join(full, bucket).select(*bucket, "cls", tiles.alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    cells = shared.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        *bucket, "cls", "tile", F.least("tile", "with").alias("tile_lo"), F.greatest("tile", "with").alias("other")
    )
    place = [*bucket, "tile_lo", "other"]
    cells = cells.join(signs.select("cls", "n", "embedding", "signs"), "cls")
    found = written(blocks(cells.repartition(*place).sortWithinPartitions(*place), least), "near-vectors")

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    per_class = signs.select("cls", "n", "least").join(links, "cls", "left").join(joined, "cls", "left")
    linked = per_class.where("component is not null")
    smallest = linked.groupBy("component").agg(F.min("least").alias("whole"))
    per_class = per_class.join(smallest, "component", "left").select(
        "cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("whole", "least").alias("component_id")
    )
    good = ok.select("id", "cls").join(per_class, "cls").select("id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("embedding"), F.col("label"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(alone)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
