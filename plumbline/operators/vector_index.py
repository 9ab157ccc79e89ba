"""Exact vector search through an inverted file: cells around fitted centroids, closed by the triangle inequality."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import col
from plumbline.session import cut_lineage, spread, tasks

TILE = 512  # vectors
BLOCK = 256  # query vectors
TILES_TOGETHER = 8  # tiles of a cell that meet a block of queries under one key
CELLS = 1024
TOGETHER = 1 << 19  # numbers of queries in one frame of wants
SLACK = 1e-7  # rounding of angles near zero, and of scores compared to nine digits


def _usable(v: pd.Series, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and those as unit rows."""
    ok, rows = np.zeros(len(v), dtype=bool), []
    for i, x in enumerate(v):
        if x is not None and len(x) == d:
            x = np.array(x, dtype=float)
            top = np.abs(x).max() if d else 0.0
            if np.isfinite(top) and top > 0:
                ok[i] = True
                rows.append(x / top / np.linalg.norm(x / top))
    return ok, np.array(rows).reshape(len(rows), d)


def _centroids(u: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``n`` cells by k-means on the sphere, from rows in a fixed order."""
    c = u[np.linspace(0, len(u) - 1, n).astype(int)]
    for _ in range(rounds):
        near = (u @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def _leading(s: np.ndarray, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where scores reach what their row needs, at most the k best of a row, to nine digits, ties by place.

    Few scores reach what is needed once a row has its first k, so rows are sorted only where more than k do.
    """
    ok = s >= need[:, None]
    many = np.flatnonzero(np.count_nonzero(ok, axis=1) > k)
    if len(many):
        best = np.argsort(-np.round(s[many], 9), axis=1, kind="stable")[:, :k]
        first = np.zeros((len(many), s.shape[1]), dtype=bool)
        np.put_along_axis(first, best, True, axis=1)
        ok[many] &= first
    return np.nonzero(ok)


def indexed_top_k(
    vectors: DataFrame,
    key: str,
    vector: str,
    queries: DataFrame,
    query_key: str,
    query_vector: str,
    k: int = 5,
    sample: int = 16384,
    scored: Accumulator | None = None,
) -> DataFrame:
    """The k most similar vectors for every query vector: ``(query_key, key, score, rank)``, exact.

    Centroids are fitted on ``sample`` vectors, those with the least key hashes; every vector is then laid in the
    cell of its nearest centroid, in tiles of at most ``TILE`` along its angle to it. The angles of a query and of a
    tile to the centroid bound their cosine from above. Queries go through cells from the best bound on, one cell,
    then 4, 16 and so on, and leave out cells and tiles whose bound is below their k-th score so far; the search ends
    when no bound is left. A bad fit costs work, never a result: where directions tell little apart, most pairs are
    scored, in matrix products of a block of queries and a tile. A full cell is many tiles, dealt over tasks.

    Vectors that are null, zero, of another length than most of the sample, or that hold null or non-finite
    components have cosine 0 with everything, on either side. Equal scores, to nine digits, go by key; null keys are
    left out. Repeated query keys are asked once for each row. ``scored`` counts the pairs scored; a task that runs
    again adds again.
    """
    spark = vectors.sparkSession
    kt, qt = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    v = vectors.select(col(key).alias("key"), col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull())
    q = queries.select(col(query_key).alias("query"), col(query_vector).cast("array<double>").alias("v"))
    drawn = v.where(F.col("v").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toPandas()["v"]
    lengths = drawn.map(len)
    d = int(lengths.mode().iloc[0]) if len(lengths) else 0
    seen = _usable(drawn, d)[1]
    n_cells = max(1, min(CELLS, math.isqrt(v.count()), len(seen)))
    middles = spark.sparkContext.broadcast(_centroids(seen, n_cells) if len(seen) else np.zeros((1, d)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok, u = _usable(pdf["v"], d)
            cos = u @ middles.value.T
            cell, angle = np.full(len(pdf), -1, dtype=np.int64), np.zeros(len(pdf))
            cell[ok] = cos.argmax(axis=1) if len(u) else []
            angle[ok] = np.arccos(np.clip(cos.max(axis=1), -1, 1)) if len(u) else []
            unit = np.full(len(pdf), None, dtype=object)
            for i, x in zip(np.flatnonzero(ok), u):
                unit[i] = x
            yield pd.DataFrame({**{c: pdf[c] for c in pdf.columns if c != "v"}, "cell": cell, "angle": angle, "u": unit})

    placed = cut_lineage(spread(v).mapInPandas(assign, f"key {kt}, cell long, angle double, u array<double>"))
    none = placed.where("cell < 0").orderBy("key").limit(k).agg(F.collect_list("key").alias("z"))
    first = placed.orderBy("key").limit(k).agg(F.collect_list("key").alias("z"))
    full = placed.where("cell >= 0")
    cells = full.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("cell").toPandas()  # at most CELLS rows
    rings = spark.sparkContext.broadcast((cells["cell"].to_numpy(), cells["lo"].to_numpy(), cells["hi"].to_numpy(), np.ceil(cells["n"].to_numpy() / (TILE * TILES_TOGETHER)).astype(int)))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for pdf in batches:
            out = []
            for cell, rows in pdf.groupby("cell", sort=False):
                for start in range(0, len(rows), TILE):
                    p = rows.iloc[start : start + TILE]
                    lo, hi = p["angle"].min(), p["angle"].max()
                    p = p.sort_values("key")  # equal scores go by key
                    out.append((cell, at, lo, hi, p["key"].tolist(), np.concatenate(p["u"].to_list())))
                    at += 1
            if out:
                yield pd.DataFrame(out, columns=["cell", "tile", "lo", "hi", "keys", "m"])

    n = tasks(vectors)
    order = ["cell", "angle", "key"]
    tiled = full.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(tile, f"cell long, tile long, lo double, hi double, keys array<{kt}>, m array<double>")
    salts = dict(zip(cells["cell"].tolist(), rings.value[3].tolist()))
    deal = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, s in salts.items() if s > 1 for x in (c, s)]), F.col("cell")), F.lit(1)) if any(s > 1 for s in salts.values()) else F.lit(1)
    tiles = cut_lineage(tiled.withColumn("_s", F.pmod(F.xxhash64("tile"), deal.cast("long")).cast("int")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), BLOCK):
                p = pdf.iloc[start : start + BLOCK]
                out.append((at, p["query"].tolist(), np.concatenate(p["u"].to_list()), len(p)))
                at += 1
            if out:
                yield pd.DataFrame(out, columns=["block", "asked", "m", "n"])

    asking = cut_lineage(spread(q).mapInPandas(assign, f"query {qt}, cell long, angle double, u array<double>"))
    # queries of one cell want the same cells: they lie in one block
    laid = asking.where("cell >= 0").withColumn("_r", F.monotonically_increasing_id()).repartitionByRange(n, "cell", "angle", "_r").sortWithinPartitions("cell", "angle")
    blocks = cut_lineage(laid.select("query", "u").mapInPandas(pack, f"block long, asked array<{qt}>, m array<double>, n int"))

    def plan(begin: int, end: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, lo, hi, dealt = rings.value
            names = ["cell", "block", "ix", "asked", "q", "need", "theta", "_s"]
            for pdf in batches:
                out, size = [], 0
                for r in pdf.itertuples():
                    m, need = np.array(r.m).reshape(r.n, d), np.array(r.need, dtype=float)
                    theta = np.arccos(np.clip(m @ middles.value[ids].T, -1, 1))
                    bound = np.cos(np.maximum(0, np.maximum(theta - hi, lo - theta)))
                    ranked = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                    rank = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(rank, ranked, True, axis=1)
                    wanted = rank & (bound >= need[:, None] - SLACK)
                    for j in np.flatnonzero(wanted.any(axis=0)):
                        ix = np.flatnonzero(wanted[:, j])
                        row = (int(ids[j]), r.block, ix, [r.asked[i] for i in ix], m[ix].ravel(), need[ix], theta[ix, j])
                        for part in range(dealt[j]):
                            out.append((*row, part))
                            size += row[4].size
                            if size > TOGETHER:
                                yield pd.DataFrame(out, columns=names)
                                out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

        return run

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["block", "i", "query", "key", "score"]
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                theta, need = np.array(r.theta), np.array(r.need)
                some = np.flatnonzero(np.cos(np.maximum(0, np.maximum(theta - r.hi, r.lo - theta))) >= need - SLACK)
                if not len(some):
                    continue
                s = np.array(r.q).reshape(-1, d)[some] @ np.array(r.m).reshape(-1, d).T
                if scored is not None:
                    scored.add(s.size)
                i, j = _leading(s, need[some] - SLACK, k)
                out += zip([r.block] * len(i), np.array(r.ix)[some][i].tolist(), [r.asked[x] for x in some[i]], [r.keys[x] for x in j], s[i, j].tolist())
                if len(out) > TOGETHER >> 4:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    def leaders(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("block", "i").orderBy(F.desc(F.round("score", 9)), F.asc("key"))
        return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    row = f"block long, i long, query {qt}, key {kt}, score double"
    wanting = f"cell long, block long, ix array<long>, asked array<{qt}>, q array<double>, need array<double>, theta array<double>, _s int"
    # vectors without a direction score 0 with every query: the k least keys of them stand for all
    ids = blocks.select("block", F.posexplode("asked").alias("i", "query"))
    best = cut_lineage(ids.select("block", F.col("i").cast("long").alias("i"), "query", F.explode(none.scalar()).alias("key"), F.lit(0.0).alias("score")))
    begin, end = 0, 1
    while begin < len(cells):
        least = best.groupBy("block", "i").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("s"))
        held = least.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("least"))  # at most BLOCK entries
        below = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.element_at("least", i.cast("long")), F.lit(-2.0)))
        wanted = cut_lineage(blocks.join(held, "block", "left").withColumn("need", below).drop("least").repartition(n, "block").mapInPandas(plan(begin, end), wanting))
        if not wanted.isEmpty():
            found = wanted.join(tiles, ["cell", "_s"]).mapInPandas(score, row)
            best = cut_lineage(leaders(best.select("block", "i", "query", "key", "score").union(found)).drop("rank"))
        begin, end = end, end * 4 + 1
    # a query without a direction scores 0 with every vector
    lost = asking.where("cell < 0").select("query", F.posexplode(first.scalar()).alias("rank", "key"))
    lost = lost.select("query", "key", F.lit(0.0).alias("score"), (F.col("rank") + 1).cast("long").alias("rank"))
    every = leaders(best).select("query", "key", "score", "rank").union(lost)
    return every.select(F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank")
