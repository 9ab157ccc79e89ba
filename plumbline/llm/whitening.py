"""Embedding whitening by contour integration.

Vectors become whole numbers, so counts and sums are exact. The covariance is added up in tasks
over centred rows. Its leading eigenvectors are found by FEAST: the spectrum is sliced into
intervals at gaps, every interval's projector is applied to a block of random vectors by quadrature
over a circle around it, each quadrature point a complex shifted solve of its own task, and
Rayleigh-Ritz on the result gives the interval's eigenpairs. Counts of eigenvalues above a shift,
by the inertia of the shifted covariance, place the intervals and verify that none is missed.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.model import col

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 40)
COMPONENTS = 8
SLICE = 16  # eigenvalues of one interval, unless more lie too close to be told apart
NODES = 16
ROUNDS = 40
ALIKE = 1e-9  # eigenvalues closer than this share of the largest are not parted
NOTHING = 1e-11  # an eigenvalue below this share of the largest is taken for zero
SEED = 11


# ---- the inertia of shifted covariances


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix congruent to ``v`` by reflections, so of its inertia at every shift."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.sqrt(x @ x)
        if not size:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.sqrt(x @ x)
        p = a[k + 1 :, k + 1 :] @ x
        w = 2 * (p - (x @ p) * x)
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1, k] = a[k, k + 1] = -size if x[0] >= 0 else size
    return np.diag(a).copy(), np.abs(np.diag(a, -1))


def above(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are larger than each shift: the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny * 1e10
    count = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (beside[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def nth_largest(diagonal: np.ndarray, beside: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eigenvalues at these places, counted from 1 by falling value, by bisection on the inertia."""
    spread = np.abs(diagonal) + np.append(beside, 0) + np.append(0, beside)
    lo, hi = np.full(len(places), -spread.max()), np.full(len(places), spread.max())
    for _ in range(64):
        mid = (lo + hi) / 2
        more = above(diagonal, beside, mid) >= places
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    return (lo + hi) / 2


def slices(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the ``k`` largest eigenvalues, cut at gaps.

    An interval holds about ``SLICE`` eigenvalues, more if no gap comes sooner; the last one holds
    what cannot be parted from the k-th.
    """
    n = len(v)
    diagonal, beside = tridiagonal(v)
    e = lambda place: float(nth_largest(diagonal, beside, np.array([place]))[0])
    top = e(1)
    if top <= 0:
        return []
    out, done, high = [], 0, top * (1 + 1e-3)
    while done < k:
        upto = min(done + SLICE, k)
        here = e(upto)
        if here <= NOTHING * top:
            upto = int(above(diagonal, beside, np.array([NOTHING * top]))[0])
            if upto > done:
                out.append((NOTHING * top, high, upto - done))
            break
        while upto < n and here - (after := e(upto + 1)) <= ALIKE * top:
            upto, here = upto + 1, after
        low = (here + e(upto + 1)) / 2 if upto < n else here - 1e-3 * top
        out.append((low, high, upto - done))
        done, high = upto, low
    counted = above(diagonal, beside, np.array([low for low, *_ in out]))
    assert list(counted) == list(np.cumsum([c for *_, c in out])), "inertia counts differ from the slices"
    return out


# ---- FEAST


def node_term(v: np.ndarray, block: np.ndarray, low: float, high: float, node: int) -> np.ndarray:
    """One quadrature point's share of the projector of [low, high] applied to ``block``."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + x[node])
    turn = (high - low) / 2 * np.exp(1j * angle)
    shifted = ((low + high) / 2 + turn) * np.eye(len(v)) - v
    return w[node] / 2 * (turn * np.linalg.solve(shifted, block)).real


def rayleigh_ritz(v: np.ndarray, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit vectors of ``v`` on the space of ``projected``."""
    basis = np.linalg.qr(projected)[0]
    values, small = np.linalg.eigh(basis.T @ (v @ basis))
    return values[::-1], (basis @ small)[:, ::-1]


def eigenpairs(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``v`` that are above zero, falling, and their vectors in columns.

    Every round is a Spark job of one task for each interval and quadrature point. The driver adds up
    their blocks, as long as the dimension and some times as wide as the eigenvalues looked for, and
    does the Rayleigh-Ritz step. It ends when every interval holds as many converged pairs as its
    inertia says; an interval that stays short gets a wider block.
    """
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    cut = slices(v, k)
    n = len(v)
    scale = max((high for _, high, _ in cut), default=1.0)
    rng = np.random.default_rng(SEED)
    widths = {i: min(n, c + max(24, 2 * c)) for i, (*_, c) in enumerate(cut)}
    blocks = {i: rng.standard_normal((n, w)) for i, w in widths.items()}
    matrix = spark.sparkContext.broadcast(v)  # dimension squared, whatever the rows
    for turn in range(ROUNDS):
        open_slices = [i for i in range(len(cut)) if i not in found]
        if not open_slices:
            break
        shared = spark.sparkContext.broadcast({i: (*cut[i][:2], blocks[i]) for i in open_slices})

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    i, node = open_slices[number // NODES], number % NODES
                    low, high, block = shared.value[i]
                    term = node_term(matrix.value, block, low, high, node)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([node]), pa.array([term.tobytes()], pa.binary())], names=["slice", "node", "term"])

        tasks = len(open_slices) * NODES
        terms = spark.range(0, tasks, 1, tasks).mapInArrow(solve, "slice long, node long, term binary")
        projected = {i: np.zeros_like(blocks[i]) for i in open_slices}
        for row in terms.toLocalIterator():  # a block each, in the order of the nodes
            projected[row.slice] += np.frombuffer(row.term).reshape(n, -1)
        for i in open_slices:
            low, high, count = cut[i]
            values, vectors = rayleigh_ritz(v, projected[i])
            inside = (values > low) & (values <= high)
            rest = np.linalg.norm(v @ vectors - vectors * values, axis=0)
            if inside.sum() == count and (rest[inside] <= 4e-15 * n * scale).all():
                found[i] = values[inside], vectors[:, inside]
                continue
            blocks[i] = vectors
            if turn % 10 == 9 and vectors.shape[1] < n:  # slow: a wider block
                more = min(n - vectors.shape[1], vectors.shape[1])
                blocks[i] = np.hstack([vectors, rng.standard_normal((n, more))])
    if len(found) < len(cut):
        raise RuntimeError("eigenvalues of an interval did not converge")
    if not cut:
        return np.zeros(0), np.zeros((n, 0))
    values = np.concatenate([found[i][0] for i in range(len(cut))])[:k]
    vectors = np.hstack([found[i][1] for i in range(len(cut))])[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


# ---- statistics of the whole table


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(lists: pa.Array, dim: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of every entry; entries beyond 2 ** 40 in size count as that."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return np.floor(np.clip(flat * scale, -LARGEST, LARGEST)).astype(np.int64) + offset


def parts_of(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about 4 MB of numbers."""
    step = max(1, (1 << 19) // dim)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def exact_sums(rows: DataFrame, dim: int, scale: int, offset: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of every dimension, as Python's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, seen = np.zeros(dim, np.int64), 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array(np.append(n, total))], names=["i", "s"])

        for batch in batches:
            for part in parts_of(batch, dim):
                x = whole_numbers(part.column("v"), dim, scale, offset)
                total += x.sum(axis=0)
                n += len(x)
                seen += len(x)
                if seen > 1 << 21:  # before a sum can leave 64 bits
                    yield out()
                    total[:], n, seen = 0, 0, 0
        yield out()

    sums = rows.select("v").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.i: int(r.s) for r in sums.collect()}  # a row for each dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


@dataclass(frozen=True)
class Centre:
    """The exact mean, S / n, as a whole part and the rest below 1."""

    n: int
    sums: tuple[int, ...]
    scale: int
    offset: int

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, lists: pa.Array) -> np.ndarray:
        """x - S / n, rounded once."""
        x = whole_numbers(lists, len(self.sums), self.scale, self.offset)
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, lists: pa.Array) -> pa.Array:
        """Sum over dimensions of (n * x - S) ** 2, exact."""
        x = whole_numbers(lists, len(self.sums), self.scale, self.offset) - self.whole
        left = np.array([s % self.n for s in self.sums], object)
        largest = (int(np.abs(x).max(initial=0)) + 1) * self.n
        if largest * largest * len(self.sums) < 1 << 63:
            d = x * self.n - left.astype(np.int64)
            return pa.array((d * d).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        d = x.astype(object) * self.n - left
        return pa.array([Decimal(int(s)) if s < 10**38 else None for s in (d * d).sum(axis=1)], pa.decimal128(38, 0))


def covariance(rows: DataFrame, centre: Centre) -> np.ndarray:
    """Sum of products of centred entries, by n. Tasks add up their rows; matrix rows are added up apart."""
    dim = len(centre.sums)
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for part in parts_of(batch, dim):
                y = shared.value.centred(part.column("v"))
                total += y.T @ y
        for start in range(0, dim, 256):
            rows_out = total[start : start + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(rows_out), dtype=np.int32)), pa.array([r.tobytes() for r in rows_out], pa.binary())], names=["i", "products"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, products in zip(batch.column("i").to_pylist(), batch.column("products")):
                own = total.setdefault(i, np.zeros(dim))
                own += np.frombuffer(products.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["i", "products"])

    schema = "i int, products binary"
    sums = rows.select("v").mapInArrow(count, schema).repartition(min(dim, 32), "i").mapInArrow(add, schema)
    out = np.zeros((dim, dim))
    for row in sums.toLocalIterator():  # a row of the matrix each
        out[row.i] = np.frombuffer(row.products)
    return (out + out.T) / (2 * centre.n)


@dataclass(frozen=True)
class Components:
    """Leading principal components: unit vectors in columns, eigenvalues by falling size, their shares of the trace."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def whiten(self, lists: pa.Array) -> np.ndarray:
        return self.centre.centred(lists) @ self.vectors / np.sqrt(self.values)


def fit_rows(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows to fit and their dimension: the commonest length above 0, of equally common ones the largest."""
    v = col(vector).cast("array<double>")
    rows = df.select(col(key).alias("id"), v.alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0].dim if common else 0
    return rows.where(F.size("v") == dim), dim


def principal_components(rows: DataFrame, dim: int, k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Components:
    """The components of all ``rows`` (column ``v``, ``dim`` entries each); fewer than ``k`` where the others have no variance."""
    n, sums = exact_sums(rows, dim, scale, offset)
    centre = Centre(n, tuple(sums), scale, offset)
    v = covariance(rows, centre)
    values, vectors = eigenpairs(rows.sparkSession, v, min(k, dim))
    trace = float(np.trace(v))
    return Components(centre, values, vectors, values / trace if trace else values)


def identity_error(white: DataFrame, k: int) -> float:
    """The largest entry, in size, of the covariance of the whitened rows (column ``w``) less the identity."""
    at = lambda i: F.element_at("w", i + 1)
    means = white.agg(*[F.avg(at(i)) for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = white.agg(*[F.avg((at(i) - F.lit(means[i])) * (at(j) - F.lit(means[j]))) for i, j in pairs]).first()
    return max((abs(p - (i == j)) for (i, j), p in zip(pairs, products)), default=0.0)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Per row and component ``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Every entry c becomes x = floor(scale * c) + offset. ``n`` rows are fitted, all that remain;
    ``deviation`` is the sum of (n * x - S) ** 2, S the sums of x, as decimal(38,0), null beyond;
    ``whitened`` is x - S / n on the component, over the root of its eigenvalue; ``explained`` its
    share of the trace. ``identity_error`` measures the covariance of all whitened rows.

    Rows drop out whose vector is null or holds a null or non-finite entry, and those of another
    length than most. Entries beyond 2 ** 40 after scaling count as 2 ** 40. Repeated rows count as
    often as they stand there; null ids stay null. Equal eigenvalues get some basis of their space, the
    same for all rows; components without variance (all rows equal, one row, an empty table) are
    left out. Other columns of ``df``, whatever their names, play no part.

    The driver holds matrices of the dimension squared. The table is read once for each of the
    lengths, the sums, the covariance and the projection, and one whitened row is written for each row.
    """
    spark = df.sparkSession
    rows, dim = fit_rows(df, key, vector)
    kind = df.select(col(key)).schema[0].dataType.simpleString()
    found = principal_components(rows, dim, k, scale, offset) if dim else None
    if found is None or not len(found.values):
        return spark.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    shared = spark.sparkContext.broadcast(found)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Components = shared.value
        for batch in batches:
            for part in parts_of(batch, dim):
                w = own.whiten(part.column("v"))
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * k)
                lists = pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), own.centre.deviations(part.column("v")), lists], names=["id", "deviation", "w"])

    white = written(rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    error = identity_error(white, k)
    share = F.element_at(F.array(*[F.lit(float(e)) for e in found.explained]), F.col("at") + 1)
    return white.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(found.centre.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )
