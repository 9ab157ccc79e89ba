"""Row and entity anomaly scores. Forests come from bounded samples, neighbours from all rows; every row is scored."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import scalar_row
from plumbline.model import any_of, col, stack_structs
from plumbline.session import cut_lineage, spread, tasks
from plumbline.operators.aggregates import entity_baseline


def _stats_row(df: DataFrame, columns: Sequence[str]) -> Column:
    parts = {}
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        parts[f"m{i}"], parts[f"s{i}"] = F.avg(x), F.stddev_pop(x)
    return scalar_row(df, **parts)


def diagonal_distance(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Distance from the mean in sigmas over several columns, ignoring correlations."""
    s = _stats_row(df, columns)
    terms = F.lit(0.0)
    for i, c in enumerate(columns):
        z = F.try_divide(col(c).cast("double") - s[f"m{i}"], s[f"s{i}"])
        terms = terms + F.coalesce(z * z, F.lit(0.0))
    return df.withColumn("distance", F.sqrt(terms)).withColumn("is_anomaly", F.col("distance") > threshold)


def peer_group_column(df: DataFrame, candidates: Sequence[str], max_unique: float = 0.5) -> str | None:
    """First categorical column with enough repetition to define peers (one row of exact counts decides)."""
    row = df.agg(*[x for i, c in enumerate(candidates) for x in (F.count_distinct(col(c)).alias(f"d{i}"), F.count(col(c)).alias(f"n{i}"))]).first()
    for i, c in enumerate(candidates):
        d, nn = row[f"d{i}"], row[f"n{i}"]
        if d >= 2 and d / nn <= max_unique:
            return c
    return None


def explain_by_peers(df: DataFrame, key: str, columns: Sequence[str], group: str | None = None, min_peers: int = 3) -> DataFrame:
    """Per row and feature: z against its peer group (or all rows) and its share of the squared distance."""
    s = _stats_row(df, columns)
    base = df
    if group:
        g = df.groupBy(col(group).alias("_g")).agg(
            F.count(F.lit(1)).alias("_n"), *[x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"_m{i}"), F.stddev_pop(col(c)).alias(f"_s{i}"))]
        )
        base = df.join(g, col(group).eqNullSafe(F.col("_g")))
    zs = []
    for i, c in enumerate(columns):
        m, sd = s[f"m{i}"], s[f"s{i}"]
        if group:
            big = F.col("_n") >= min_peers
            m, sd = F.when(big, F.col(f"_m{i}")).otherwise(m), F.when(big, F.col(f"_s{i}")).otherwise(sd)
        zs.append(F.coalesce(F.try_divide(col(c).cast("double") - m, sd), F.lit(0.0)))
    b = base.select(col(key).alias("key"), F.array(*zs).alias("_z"))
    total = F.aggregate("_z", F.lit(0.0), lambda a, z: a + z * z)
    rows = [F.struct(F.lit(c).alias("feature"), F.col("_z")[i].alias("z"), F.coalesce(F.try_divide(F.col("_z")[i] * F.col("_z")[i], F.col("_t")), F.lit(0.0)).alias("contribution")) for i, c in enumerate(columns)]
    return b.withColumn("_t", total).select("key", F.explode(F.array(*rows)).alias("r")).select("key", "r.*")


def control_chart(df: DataFrame, columns: Sequence[str], usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """Three-sigma limits, points outside them, and capability against given or observed limits."""
    s = _stats_row(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        m, sd = s[f"m{i}"], s[f"s{i}"]
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.count(x).alias(f"n{i}"), F.count_if((x > m + 3 * sd) | (x < m - 3 * sd)).alias(f"o{i}")]
    rows = []
    for i, c in enumerate(columns):
        m, sd = F.col(f"m{i}"), F.col(f"s{i}")
        hi = F.lit(usl) if usl is not None else F.col(f"b{i}")
        lo = F.lit(lsl) if lsl is not None else F.col(f"a{i}")
        cpk = F.least(F.try_divide(hi - m, 3 * sd), F.try_divide(m - lo, 3 * sd))
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), m.alias("mean"), sd.alias("sigma"), (m - 3 * sd).alias("lcl"), (m + 3 * sd).alias("ucl"), F.col(f"o{i}").alias("out_of_control"), F.round(cpk, 3).alias("cpk")))
    return stack_structs(df.agg(*aggs), rows)


def entity_deviation(df: DataFrame, entity: Sequence[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Rows far from their own entity's mean. Baselines are combined map-side and joined back."""
    b = entity_baseline(df, entity, value).select(*[col(e).alias(f"_e{i}") for i, e in enumerate(entity)], F.col("mean").alias("_m"), F.col("sigma").alias("_s"))
    on = F.lit(True)
    for i, e in enumerate(entity):
        on = on & (col(e) == F.col(f"_e{i}"))
    z = F.try_divide(col(value) - F.col("_m"), F.col("_s"))
    out = df.join(b, on).withColumn("z", z).where(F.abs("z") > threshold)
    return out.drop("_m", "_s", *[f"_e{i}" for i in range(len(entity))])


def spikes(df: DataFrame, value: str, threshold: float = 2.5) -> DataFrame:
    """Values 2.5 or more sigmas from the mean, with direction and severity."""
    s = _stats_row(df, [value])
    z = F.try_divide(col(value) - s["m0"], s["s0"])
    out = df.withColumn("z", z).where(F.abs("z") >= threshold)
    sev = F.when(F.abs("z") >= 4, "critical").when(F.abs("z") >= 3, "high").otherwise("medium")
    return out.withColumns({"kind": F.when(F.col("z") > 0, "spike").otherwise("drop"), "severity": sev})


# ---- isolation forest ---------------------------------------------------------------

TREES, SAMPLE, CUT = 64, 256, 0.6


def _mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append([-1, 0.0, at, at, depth + _mean_path(len(x))])
    f = int(rng.integers(x.shape[1]))
    lo, hi = (x[:, f].min(), x[:, f].max()) if len(x) else (0.0, 0.0)
    if depth >= limit or len(x) <= 1 or lo == hi:
        return at
    cut = lo + rng.random() * (hi - lo)
    low = x[:, f] < cut
    left = _grow(x[low], rng, depth + 1, limit, nodes)
    right = _grow(x[~low], rng, depth + 1, limit, nodes)
    nodes[at] = [f, float(cut), left, right, 0.0]
    return at


def isolation_forest(df: DataFrame, columns: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE, threshold: float = CUT, seed: int = 3) -> DataFrame:
    """Isolation scores for every row; null where a feature is missing.

    Every tree draws its own rows from the whole table, by a hash of key and tree, and grows in a
    task of its own; the forest (a few thousand nodes) scores all rows in Arrow batches.
    """
    cols = list(columns)
    feats = [col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(cols)]
    whole = df.where(F.lit(True))
    for c in cols:
        whole = whole.where(col(c).isNotNull() & ~F.isnan(col(c).cast("double")))
    n = whole.count()
    # each tree's draw: about twice the sample passes, of which the sample's least hashes stay
    draw = lambda tree: F.pmod(F.xxhash64(col(key), F.lit(seed), tree), F.lit(2**31))
    share = F.lit(int(min(1.0, (2 * sample + 40) / max(n, 1)) * 2**31))
    drawn = whole.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)))
    w = Window.partitionBy("tree").orderBy(draw(F.col("tree")), *feats)
    picks = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).select("tree", "_r", *feats)
    names = [f"_f{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        tree = int(pdf["tree"].iloc[0])
        nodes: list = []
        x = pdf[names].to_numpy()
        _grow(x, np.random.default_rng([seed, tree]), 0, max(1, math.ceil(math.log2(max(2, len(x))))), nodes)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", range(len(nodes)))
        out.insert(0, "tree", tree)
        out["size"] = len(x)
        return out

    grown = picks.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, path double, size int")
    forest = grown.toPandas()  # bounded: trees x at most 2 * sample nodes
    norm = _mean_path(int(forest["size"].max())) if len(forest) else 1.0
    parts = [g.sort_values("node")[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in forest.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype=int)
                for _ in range(len(t)):
                    f = t[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.maximum(f, 0)] < t[at, 1]
                    at = np.where(inner, np.where(go_left, t[at, 2], t[at, 3]).astype(int), at)
                total += t[at, 4]
            s = np.power(2.0, -(total / max(1, len(shared.value))) / (norm or 1.0))
            yield pd.DataFrame({"key": pdf["key"], "score": s})

    key_type = df.schema[key].dataType.simpleString()
    out = spread(whole.select(col(key).alias("key"), *feats)).mapInPandas(score, f"key {key_type}, score double")
    gaps = any_of([col(c).isNull() | F.isnan(col(c).cast("double")) for c in cols])
    out = out.unionByName(df.where(gaps).select(col(key).alias("key"), F.lit(None).cast("double").alias("score")))
    return out.withColumn("is_anomaly", F.col("score") > threshold)


# ---- nearest-neighbour score --------------------------------------------------------

TILE = 512  # points
FAN = 8  # bits: 256 boxes in one
TOP = 1024  # boxes that the driver may hold


def _terms(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Feature terms of every pair, shape (features, x, y). A gap on either side is a full difference."""
    out = np.empty((x.shape[1] + cx.shape[1], len(x), len(y)))
    for i, s in enumerate(spans):
        a, b = x[:, i][:, None], y[:, i][None, :]
        d = np.abs(a - b) / s if s > 0 else np.zeros((len(x), len(y)))
        out[i] = np.where(np.isnan(a) | np.isnan(b), 1.0, d)
    for i in range(cx.shape[1]):
        codes, _ = pd.factorize(np.concatenate([cx[:, i], cy[:, i]]))
        a, b = codes[: len(cx)][:, None], codes[len(cx) :][None, :]
        out[len(spans) + i] = np.where((a == b) & (a >= 0), 0.0, 1.0)
    return out


def _reach(dist: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Distance within which each row has ``k`` neighbours by weight; infinite where it has fewer."""
    order = np.argsort(dist, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(w, order, axis=1), axis=1)
    at = np.minimum((total < k).sum(axis=1), dist.shape[1] - 1)
    far = np.take_along_axis(dist, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
    return np.where(total[:, -1] >= k, far, np.inf)


def _gaps(own: tuple, lo: np.ndarray, hi: np.ndarray, gaps: np.ndarray, one: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and widest distance (times the features) between a box and each of many boxes."""
    own_lo, own_hi, own_gaps, own_one, own_mask = own
    least, most = np.zeros(len(lo)), np.zeros(len(lo))
    for i, s in enumerate(spans):
        gap = gaps[:, i] | own_gaps[i]
        if s > 0:
            least += np.clip(np.maximum(lo[:, i] - own_hi[i], own_lo[i] - hi[:, i]) / s, 0, 1)
            most += np.where(gap, 1.0, np.maximum(hi[:, i] - own_lo[i], own_hi[i] - lo[:, i]) / s)
        else:
            most += gap.astype(float)
    for i in range(len(own_mask)):
        both = np.array([v is not None for v in one[:, i]]) & (own_one[i] is not None)
        differ = np.where(both, one[:, i] != own_one[i], (mask[:, i] & own_mask[i]) == 0)
        least += differ
        most += ~(both & ~differ)
    return least, most


def gower_knn(
    df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 10, compared: Accumulator | None = None
) -> DataFrame:
    """Mean Gower distance of every row to its k nearest other rows, with each feature's share.

    Exact at every size. Equal rows become one weighted point; points lie in tiles along a
    space-filling order within their categories, and ``2 ** FAN`` boxes in a row have one box around
    them, up to a level of at most ``TOP`` boxes: the only ones that the driver holds. A tile's own
    points, and the widest distances to the boxes around it, bound how far its neighbours can be; the
    tile goes down the tree level by level, each level a join, into just those boxes that come nearer
    than that. At the tiles each point asks on its own bound. Equal distances go by the features' terms.
    ``compared`` counts the pairs of points compared; a task that runs again adds again.
    """
    nums, cats = list(numeric), list(categorical)
    names, d, m = nums + cats, len(nums), len(nums) + len(cats)
    fn, fc = [f"n{i}" for i in range(d)], [f"c{i}" for i in range(len(cats))]
    real = lambda c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double"))
    base = df.select(col(key).alias("key"), *[real(c).alias(f) for c, f in zip(nums, fn)], *[col(c).cast("string").alias(f) for c, f in zip(cats, fc)])
    points = cut_lineage(base.groupBy(*fn, *fc).agg(F.count(F.lit(1)).alias("w")))
    ends = points.agg(F.count(F.lit(1)).alias("points"), F.sum("w").alias("rows"), *[x for f in fn for x in (F.min(f).alias(f"a{f}"), F.max(f).alias(f"b{f}"))]).first()
    rows = ends["rows"] or 0
    near = min(max(3, min(k, rows - 1)), rows - 1)
    low = [ends[f"a{f}"] for f in fn]
    spans = np.array([ends[f"b{f}"] - ends[f"a{f}"] if ends[f"a{f}"] is not None else 0.0 for f in fn], dtype=float)
    kt = df.schema[key].dataType.simpleString()
    share_map = lambda c: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), c)
    if near < 1:  # nothing to compare with
        return base.select("key", F.lit(None).cast("double").alias("raw_score"), share_map(F.array_repeat(F.lit(None).cast("double"), m)).alias("contributions"))

    # bits of the scaled features in turn: points near each other in all features lie near in this order
    bits, curve = min(16, 62 // max(1, min(d, 62))), F.lit(0).cast("long")
    for i, f in enumerate(fn[:62] if d > 1 else []):
        q = F.coalesce(F.floor((F.col(f) - F.lit(low[i])) / F.lit(spans[i]) * (2**bits - 1)), F.lit(0)).cast("long") if spans[i] > 0 else F.lit(0).cast("long")
        for b in range(bits):
            curve = curve.bitwiseOR(F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1).cast("long")), b * min(d, 62) + i))
    along = [*fc, "_z", *fn]
    parts = min(tasks(df), math.ceil(ends["points"] / (4 * TILE)))
    laid = points.withColumn("_z", curve).repartitionByRange(parts, *along).sortWithinPartitions(*along)

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            for ix in np.array_split(np.arange(len(pdf)), math.ceil(len(pdf) / TILE)):
                p = pdf.iloc[ix]
                x, c = p[fn].to_numpy(dtype=float), p[fc].to_numpy(dtype=object)
                held = [set(v for v in c[:, i] if v is not None) for i in range(len(cats))]
                gap = np.isnan(x)
                one = [next(iter(h)) if len(h) == 1 and all(v is not None for v in c[:, i]) else None for i, h in enumerate(held)]
                mask = [int(np.bitwise_or.reduce([1 << (zlib.crc32(v.encode()) % 63) for v in h])) if h else 0 for h in held]
                out.append((
                    at, x.ravel(), list(c.ravel()), p["w"].to_numpy(), int(p["w"].sum()), np.where(gap, np.inf, x).min(axis=0), np.where(gap, -np.inf, x).max(axis=0),
                    gap.any(axis=0).astype(float), one, mask,
                ))
                at += 1
            yield pd.DataFrame(out, columns=["tile", "x", "c", "w", "total", "lo", "hi", "gaps", "one", "mask"])

    box = "total long, lo array<double>, hi array<double>, gaps array<double>, one array<string>, mask array<long>"
    tiles = cut_lineage(laid.select(*fn, *fc, "w").mapInPandas(tile, f"tile long, x array<double>, c array<string>, w array<long>, {box}"))
    parts_of_box = ["total", "lo", "hi", "gaps", "one", "mask"]

    def around(level: DataFrame) -> DataFrame:
        """Boxes around runs of boxes, each with the boxes in it: at most ``2 ** FAN``, as tiles are numbered in order."""
        at = lambda c, i: F.element_at(c, i + 1)
        alike = lambda i: F.when((F.count(at("one", i)) == F.count(F.lit(1))) & (F.min(at("one", i)) == F.max(at("one", i))), F.min(at("one", i)))
        up = level.groupBy(F.shiftright("node", FAN).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("node", *parts_of_box))).alias("kids"),
            F.sum("total").alias("total"),
            *[F.array(*[of(at(c, i)) for i in range(n)]).cast(t).alias(c) for c, of, n, t in (
                ("lo", F.min, d, "array<double>"), ("hi", F.max, d, "array<double>"), ("gaps", F.max, d, "array<double>"), ("mask", F.bit_or, len(cats), "array<long>"),
            )],
            F.array(*[alike(i) for i in range(len(cats))]).cast("array<string>").alias("one"),
        )
        flat = [F.col("kids.node").alias("k_node"), F.col("kids.total").alias("k_total"), *[F.flatten(f"kids.{c}").alias(f"k_{c}") for c in parts_of_box[1:]]]
        return cut_lineage(up.select(F.col("up").alias("node"), *parts_of_box, *flat))

    levels = [around(tiles.select(F.col("tile").alias("node"), *parts_of_box))]
    while levels[-1].count() > TOP:
        levels.append(around(levels[-1].select("node", *parts_of_box)))
    boxes = levels[-1].select("node", *parts_of_box).toPandas()  # at most TOP boxes
    stacked = lambda c, n, t=float: np.array([list(v) for v in boxes[c]], dtype=t).reshape(len(boxes), n)
    shared = df.sparkSession.sparkContext.broadcast((boxes["node"].to_numpy(), boxes["total"].to_numpy(), stacked("lo", d), stacked("hi", d), stacked("gaps", d) > 0, stacked("one", len(cats), object), stacked("mask", len(cats), np.int64)))

    def points_of(x, c, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.array(x, dtype=float).reshape(n, d), np.array(list(c), dtype=object).reshape(n, len(cats))

    def own_box(r) -> tuple:
        return np.array(r.lo, dtype=float), np.array(r.hi, dtype=float), np.array(r.gaps, dtype=float) > 0, list(r.one), np.array(r.mask, dtype=np.int64)

    def kids_of(r) -> tuple:
        n = len(r.k_node)
        flat = lambda v, w, t=float: np.array(list(v), dtype=t).reshape(n, w)
        return np.array(r.k_node), np.array(r.k_total), flat(r.k_lo, d), flat(r.k_hi, d), flat(r.k_gaps, d) > 0, flat(r.k_one, len(cats), object), flat(r.k_mask, len(cats), np.int64)

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, totals, *rest = shared.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, c = points_of(r.x, r.c, len(r.w))
                w = np.array(r.w)
                weights = np.tile(w, (len(w), 1)) - np.eye(len(w), dtype=np.int64)
                limit = _reach(_terms(x, x, c, c, spans).mean(axis=0), weights, near)
                # limits from whole boxes: the nearest of them that hold k rows besides the row itself
                own = own_box(r)
                least, most = _gaps(own, *rest, spans)
                _, k_totals, *k_rest = kids_of(r)
                for far, held in ((most, totals), (_gaps(own, *k_rest, spans)[1], k_totals)):
                    limit = np.minimum(limit, _reach((far / m)[None, :], held[None, :], near + 1)[0])
                limit += 1e-9
                out.append((r.tile, limit, limit.max(), nodes[least / m <= limit.max()], r.lo, r.hi, r.gaps, r.one, r.mask))
            yield pd.DataFrame(out, columns=["asker", "reach", "widest", "nodes", *parts_of_box[1:]])

    names_in = box.removeprefix("total long, ")
    siblings = levels[0].select("node", *[c for c in levels[0].columns if c.startswith("k_")])
    homes = tiles.withColumn("node", F.shiftright("tile", FAN)).join(siblings, "node").drop("node", "total")
    entered = cut_lineage(spread(homes).mapInPandas(enter, f"asker long, reach array<double>, widest double, nodes array<long>, {names_in}"))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                nodes, _, *rest = kids_of(r)
                least, _ = _gaps(own_box(r), *rest, spans)
                out.append((r.asker, r.widest, nodes[least / m <= r.widest], r.lo, r.hi, r.gaps, r.one, r.mask))
            yield pd.DataFrame(out, columns=["asker", "widest", "nodes", *parts_of_box[1:]])

    def met_boxes(front: DataFrame, level: DataFrame) -> DataFrame:
        """Askers beside the boxes within the boxes they reached; few boxes are dealt out so that every task has some."""
        salts = max(1, math.ceil(tasks(df) / level.count()))
        kids = level.select("node", *[c for c in level.columns if c.startswith("k_")]).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return front.withColumn("_s", F.pmod(F.xxhash64("asker"), F.lit(salts)).cast("int")).join(kids, ["node", "_s"])

    front = entered.select("asker", "widest", F.explode("nodes").alias("node"), *parts_of_box[1:])
    for level in levels[:0:-1]:
        down = met_boxes(front, level).mapInPandas(descend, f"asker long, widest double, nodes array<long>, {names_in}")
        front = cut_lineage(down.select("asker", "widest", F.explode("nodes").alias("node"), *parts_of_box[1:]))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x, c = points_of(r.x, r.c, len(r.reach))
                limit = np.array(r.reach)
                ids, _, lo, hi, _, _, mask = kids_of(r)
                bound = np.zeros((len(x), len(ids)))
                for i, s in enumerate(spans):
                    if s > 0:
                        v = x[:, i][:, None]
                        bound += np.where(np.isnan(v), 1.0, np.clip(np.maximum(lo[:, i] - v, v - hi[:, i]) / s, 0, 1))
                for i in range(len(cats)):
                    bit = np.array([0 if v is None else 1 << (zlib.crc32(v.encode()) % 63) for v in c[:, i]], dtype=np.int64)
                    bound += (bit[:, None] & mask[:, i][None, :]) == 0
                wanted = bound / m <= limit[:, None]
                wanted[:, ids == r.asker] = True
                out = []
                for j, b in enumerate(ids):
                    ix = np.flatnonzero(wanted[:, j])
                    if len(ix):
                        out.append((b, r.asker, ix, x[ix].ravel(), list(c[ix].ravel()), limit[ix]))
                for start in range(0, len(out), 256):
                    yield pd.DataFrame(out[start : start + 256], columns=["tile", "asker", "ix", "x", "c", "reach"])

    askers = entered.select("asker", "reach").join(tiles.select(F.col("tile").alias("asker"), "x", "c"), "asker")
    asking = met_boxes(front.select("asker", "node").join(askers, "asker"), levels[0])
    asked = asking.mapInPandas(ask, "tile long, asker long, ix array<long>, x array<double>, c array<string>, reach array<double>")
    met = asked.join(tiles.select("tile", F.col("x").alias("tx"), F.col("c").alias("tc"), F.col("w").alias("tw")), "tile")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x, c = points_of(r.x, r.c, len(r.ix))
                y, e = points_of(r.tx, r.tc, len(r.tw))
                if compared is not None:
                    compared.add(len(x) * len(y))
                terms = _terms(x, y, c, e, spans)
                dist = terms.mean(axis=0)
                weights = np.tile(np.array(r.tw), (len(x), 1))
                own = r.tile == r.asker
                if own:
                    weights[np.arange(len(x)), r.ix] -= 1
                cut = np.minimum(np.array(r.reach), _reach(dist, weights, near))
                close = (dist <= cut[:, None]) & (weights > 0)
                out = []
                for p in range(len(x)):
                    hit = np.flatnonzero(close[p])
                    if not len(hit) and not own:
                        continue
                    t, w = terms[:, p, hit], weights[p, hit]
                    order = np.lexsort((*t[::-1], dist[p, hit]))
                    order = order[: int((np.cumsum(w[order]) < near).sum()) + 1]
                    flat = np.column_stack([dist[p, hit][order], t[:, order].T, w[order]]).ravel()
                    out.append((r.asker, int(r.ix[p]), flat, x[p] if own else None, list(c[p]) if own else None))
                if out:
                    yield pd.DataFrame(out, columns=["asker", "i", "near", "x", "c"])

    hits = met.mapInPandas(answer, "asker long, i long, near array<double>, x array<double>, c array<string>")
    found = hits.groupBy("asker", "i").agg(F.flatten(F.collect_list("near")).alias("near"), F.first("x", True).alias("x"), F.first("c", True).alias("c"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, shares = [], []
            for flat in pdf["near"]:
                h = np.array(flat, dtype=float).reshape(-1, m + 2)
                h = h[np.lexsort(h[:, m::-1].T)]
                w = h[:, -1]
                take = np.clip(near - (np.cumsum(w) - w), 0, w)
                t = (h[:, 1 : m + 1] * take[:, None]).sum(axis=0)
                raw.append((h[:, 0] * take).sum() / near)
                shares.append(np.round(t / max(t.sum(), 1e-12), 4))
            out = {f: [v[i] for v in pdf["x"]] for i, f in enumerate(fn)} | {f: [v[i] for v in pdf["c"]] for i, f in enumerate(fc)}
            yield pd.DataFrame(out | {"raw_score": raw, "contributions": shares})

    scored = found.mapInPandas(settle, ", ".join([*[f"{f} double" for f in fn], *[f"{f} string" for f in fc], "raw_score double", "contributions array<double>"]))
    on = F.lit(True)
    for f in fn + fc:
        on = on & F.col(f"r.{f}").eqNullSafe(F.col(f"s.{f}"))
    return base.alias("r").join(scored.alias("s"), on).select(F.col("r.key").cast(kt).alias("key"), "raw_score", share_map(F.col("contributions")).alias("contributions"))


def flag_outlying_scores(scores: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Scores beyond mean + 3 sigma, with a 0-1 display score."""
    s = scalar_row(scores, m=F.avg("raw_score"), sd=F.stddev_pop("raw_score"), top=F.max("raw_score"))
    return scores.withColumns(
        {"score": F.round(F.col("raw_score") / F.greatest(s["top"], F.lit(1e-9)), 4), "is_anomaly": (s["sd"] > 0) & (F.col("raw_score") > s["m"] + sigmas * s["sd"])}
    )


def suppress_dismissed(flags: DataFrame, dismissed: Sequence[str]) -> DataFrame:
    """Drop the flag where the feature that drives it has been dismissed before; scores stay."""
    top = F.element_at(F.map_keys(F.map_filter("contributions", lambda k, v: v == F.array_max(F.map_values("contributions")))), 1)
    gone = F.col("is_anomaly") & top.isin(*dismissed) if dismissed else F.lit(False)
    return flags.withColumns({"suppressed": gone, "is_anomaly": F.col("is_anomaly") & ~gone})
