"""Whole-table statistics that stay distributed: scalar rows and exact quantiles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import col

# Narrow a quantile band until at most this many distinct rows remain to be ranked.
BAND_ROWS = 50_000
SKETCH_ACCURACY = 10_000


def scalar_row(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregate ``df`` to one struct, usable inside expressions over any other frame.

    Planned as an uncorrelated scalar subquery: no join, no driver round trip.
    """
    packed = F.struct(*[c.alias(n) for n, c in aggregates.items()])
    return df.agg(packed.alias("_s")).scalar()


def sample_skewness(c: Column) -> Column:
    """Sample-adjusted skewness (Spark's own is the population figure)."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles: rows ``(column, prob, value)``.

    A quantile sketch per column gives a narrow value band around each wanted rank;
    counting rows below the band turns the global rank into a rank within it. A band that
    missed its rank is widened, one that is still large is narrowed by another scan, and
    only the few distinct values left are grouped and ranked. No scan shuffles its rows, so
    this works where one task could not hold a column's value counts.
    """
    spark = df.sparkSession
    tags = [(c, float(p)) for c in columns for p in probs]
    # plain number columns, NaN as null: the conversion is done once per row and not once per check
    number = {c: col(c).cast("double") for c in columns}
    df = df.select(*[F.when(~F.isnan(number[c]), number[c]).alias(f"v{i}") for i, c in enumerate(columns)])
    value = {c: F.col(f"v{i}") for i, c in enumerate(columns)}
    sizes = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    total = {c: sizes[f"n{i}"] for i, c in enumerate(columns)}
    known = [t for t in tags if total[t[0]]]
    if not known:
        return spark.createDataFrame([(c, p, None) for c, p in tags], "column string, prob double, value double")
    # a band is (low value, high value, rows below it, rows in it); it starts as the whole column
    band: dict = {t: (None, None, 0, total[t[0]]) for t in known}
    slack = {t: 1.0 for t in known}
    todo = list(known)

    def within(t) -> Column:
        lo, hi, _, _ = band[t]
        v = value[t[0]]
        return v.isNotNull() if lo is None else v.between(F.lit(lo), F.lit(hi))

    while todo:
        asks: dict = {}
        for t in todo:
            _, _, below, n = band[t]
            rank = t[1] * (total[t[0]] - 1) - below
            room = slack[t] * (2.5 * n / SKETCH_ACCURACY + 2)
            at = [max(0.0, (rank - room) / n), min(1.0, (rank + room + 1) / n)]
            # all tags still looking at a whole column share one sketch
            asks.setdefault(t[0] if band[t][0] is None else t, []).append((t, at))
        aggs = [
            F.percentile_approx(F.when(within(wants[0][0]), value[wants[0][0][0]]), [x for _, at in wants for x in at], SKETCH_ACCURACY).alias(f"q{i}")
            for i, wants in enumerate(asks.values())
        ]
        edges = df.agg(*aggs).first()
        guess = {t: edges[f"q{i}"][2 * k : 2 * k + 2] for i, wants in enumerate(asks.values()) for k, (t, _) in enumerate(wants)}
        checks = []
        for i, t in enumerate(todo):
            lo, hi = guess[t]
            checks += [F.count_if(value[t[0]] < F.lit(lo)).alias(f"b{i}"), F.count_if(value[t[0]].between(F.lit(lo), F.lit(hi))).alias(f"w{i}")]
        seen = df.agg(*checks).first()
        again = []
        for i, t in enumerate(todo):
            below, n = seen[f"b{i}"], seen[f"w{i}"]
            pos = t[1] * (total[t[0]] - 1)
            if below > int(pos) or below + n - 1 < -int(-pos // 1):
                slack[t] *= 4
                again.append(t)
                continue
            shrank = n < band[t][3]
            band[t] = (*guess[t], below, n)
            # a band of one value, or one that heavy ties keep from shrinking, is few distinct rows
            if n > BAND_ROWS and guess[t][0] < guess[t][1] and shrank:
                again.append(t)
        todo = again
    # a band of one value that covers its ranks is the answer; only the others are looked up
    schema = "column string, prob double, value double"
    settled = [(*t, float(band[t][0])) for t in known if band[t][0] is not None and band[t][0] == band[t][1]]
    settled += [(c, p, None) for c, p in tags if not total[c]]
    known = [t for t in known if band[t][0] != band[t][1]]
    if not known:
        return spark.createDataFrame(settled, schema)
    cases = [F.when(within(t), F.struct(F.lit(i).alias("tag"), value[t[0]].alias("v"))) for i, t in enumerate(known)]
    # no filter on the bands before this: it would be pushed down and work every column out once per check
    freq = (
        df.select(F.explode(F.array(*cases)).alias("x"))
        .where(F.col("x").isNotNull())
        .groupBy("x.tag", "x.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wanted = spark.createDataFrame(
        [(i, t[0], t[1], int(band[t][2]), int(total[t[0]])) for i, t in enumerate(known)],
        "tag int, column string, prob double, below long, total long",
    )
    pos = F.col("prob") * (F.col("total") - 1)
    w = Window.partitionBy("tag").orderBy("v")
    ranked = (
        freq.withColumn("upto", F.sum("n").over(w))
        .join(F.broadcast(wanted), "tag")  # one row per column and probability
        .withColumn("first", F.col("below") + F.col("upto") - F.col("n"))
        .withColumn("last", F.col("below") + F.col("upto") - 1)
    )
    at = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("last") >= r), F.col("v")))
    low, high = F.floor(pos), F.ceil(pos)
    out = (
        ranked.withColumn("pos", pos)
        .groupBy("tag", "column", "prob", "pos")
        .agg(at(low).alias("a"), at(high).alias("b"))
        .select(
            "column",
            "prob",
            (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("value"),
        )
    )
    return out.unionByName(spark.createDataFrame(settled, schema)) if settled else out


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """Driver-side ``{(column, prob): value}``: one number per column and probability."""
    return {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, columns, probs).collect()}
