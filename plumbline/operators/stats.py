"""Intervals, effect sizes, paradox and confidence checks, tests, stress tests, learned ranking."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.distributions import chi_square_p_value, t_p_value
from plumbline.functions.ordering import with_order
from plumbline.functions.stats import quantile_map, scalar_row
from plumbline.model import any_of, col, stack_structs
from plumbline.operators.ordered_joins import asof_join
from plumbline.session import cut_lineage, spread

Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def sample_class(n: Column) -> Column:
    return F.when(n >= 30, "sufficient").when(n >= 10, "low").otherwise("insufficient")


def mean_interval(df: DataFrame, value: str, group_by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Mean, sample sigma and normal interval per group, with the sample-size class."""
    v = col(value).cast("double")
    s = df.groupBy(*[col(g) for g in group_by]).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    margin = F.when(F.col("n") >= 2, Z_SCORES[level] * F.col("sd") / F.sqrt("n"))
    return s.withColumns({"lower": F.col("mean") - margin, "upper": F.col("mean") + margin, "verdict": sample_class(F.col("n"))})


def cohens_d(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Standardised difference of two group means and its size word."""
    v = col(value).cast("double")
    x, y = F.when(col(group) == a, v), F.when(col(group) == b, v)
    s = df.agg(F.count(x).alias("na"), F.count(y).alias("nb"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    d = F.try_divide(F.col("ma") - F.col("mb"), pooled)
    size = F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")
    return s.select("na", "nb", d.alias("d"), size.alias("magnitude"))


def bonferroni(comparisons: int, alpha: float = 0.05) -> float:
    return alpha / max(1, comparisons)


def simpson_check(df: DataFrame, value: str, group: str, segment: str, a, b) -> DataFrame:
    """Direction of a two-group comparison per segment and overall, and whether any segment reverses it."""
    v = col(value).cast("double")
    g = df.where(col(group).isin(a, b)).groupBy(col(segment).cast("string").alias("segment")).agg(
        F.sum(F.when(col(group) == a, v)).alias("sa"), F.count(F.when(col(group) == a, v)).alias("na"),
        F.sum(F.when(col(group) == b, v)).alias("sb"), F.count(F.when(col(group) == b, v)).alias("nb"),
    )
    way = lambda x, y: F.when(x.isNull() | y.isNull(), None).when(x == y, "tie").when(x > y, "A").otherwise("B")
    overall = g.agg(way(F.sum("sa") / F.sum("na"), F.sum("sb") / F.sum("nb"))).scalar()
    here = way(F.try_divide(F.col("sa"), F.col("na")), F.try_divide(F.col("sb"), F.col("nb")))
    out = g.select("segment", "na", "nb", here.alias("direction"), overall.alias("overall"))
    flip = (F.col("direction") != F.col("overall")) & (F.col("direction") != "tie") & (F.col("overall") != "tie")
    return out.withColumn("reversed", F.coalesce(flip, F.lit(False)))


def grouped_confidence(df: DataFrame, group: str, value: str, level: float = 0.95) -> DataFrame:
    d = df.withColumn("group", F.coalesce(col(group).cast("string"), F.lit("(null)")))
    return mean_interval(d, value, ["group"], level)


def weakest_group(verdicts: DataFrame) -> DataFrame:
    rank = F.when(F.col("verdict") == "insufficient", 0).when(F.col("verdict") == "low", 1).otherwise(2)
    return verdicts.agg(
        F.min_by(F.struct("verdict", "group", "n"), F.struct(rank, F.col("n"), F.col("group"))).alias("w"), F.count(F.lit(1)).alias("groups")
    ).select(F.col("w.verdict").alias("verdict"), F.col("w.group").alias("group"), F.col("w.n").alias("n"), "groups")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of all column pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    s = df.agg(*[F.corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return stack_structs(s, [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept, R², and the slope's t and p."""
    a, b = col(y), col(x)
    s = df.agg(
        F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.corr(a, b).alias("r")
    )
    t = F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r")))
    s = s.withColumn("t", t).withColumn("df", (F.col("n") - 2).cast("double"))
    return s.withColumn("p", t_p_value("t", "df")).select("n", "slope", "intercept", "r2", "t", "p")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories from their cell counts."""
    cells = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n = cells.agg(F.sum("o")).scalar()
    # chi² = n * (sum of o² / (row * column) - 1): absent cells need no rows
    s = cells.join(rows, "a").join(cols, "b").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("q"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")
    )
    s = s.select((n * (F.col("q") - 1)).alias("chi_square"), ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("double").alias("df"))
    return s.withColumn("p", chi_square_p_value("chi_square", "df"))


def one_sample_t(df: DataFrame, value: str, mu: float) -> DataFrame:
    v = col(value).cast("double")
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    s = s.withColumn("t", F.try_divide(F.col("mean") - mu, F.col("sd") / F.sqrt("n"))).withColumn("df", (F.col("n") - 1).cast("double"))
    return s.withColumn("p", t_p_value("t", "df")).select("n", "mean", "t", "p")


def _draws(keys: np.ndarray, b: int) -> np.ndarray:
    """Poisson(1) weights of rows in resample ``b``: the scrambled sum of key hash and resample against the cumulative chances."""
    x = keys + np.uint64(b * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    w, total, p = np.zeros(len(x)), 0.0, math.exp(-1)
    for k in range(1, 18):
        total += p
        above = u >= np.uint64(min(total, 1.0) * 2.0**53)
        if not above.any():
            break
        w += above
        p /= k
    return w


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 500, seed: int = 12) -> DataFrame:
    """Bootstrap interval of a mean.

    Every row draws its own Poisson(1) weight in each resample, from a hash of its key; a task
    adds its rows up to one sum and count per resample before anything is shuffled.
    """
    v = col(value).cast("double")
    rows = df.where(v.isNotNull()).select(F.xxhash64(col(key), F.lit(seed)).alias("h"), v.alias("v"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = np.zeros(resamples), np.zeros(resamples)
        for pdf in batches:
            keys, x = pdf["h"].to_numpy().astype(np.int64).view(np.uint64), pdf["v"].to_numpy()
            for b in range(resamples):
                w = _draws(keys, b + 1)
                s[b] += w @ x
                n[b] += w.sum()
        yield pd.DataFrame({"b": range(resamples), "s": s, "n": n})

    sums = spread(rows).mapInPandas(weigh, "b int, s double, n double")
    means = sums.groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    ci = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))  # one value per resample
    mean = df.agg(F.avg(v)).scalar()
    lo, hi = F.col("q")[0], F.col("q")[1]
    width = F.try_divide(hi - lo, F.abs(mean))
    return ci.select(mean.alias("mean"), lo.alias("low"), hi.alias("high"), width.alias("relative_width"), (width <= 0.30).alias("robust"))


def stress_test(df: DataFrame, value: str, key: str, group: str | None = None, trim: float = 0.05, tolerance: float = 0.10) -> DataFrame:
    """Does a mean survive resampling, a trim of both tails and the loss of its largest group."""
    v = col(value).cast("double")
    base = df.agg(F.avg(v)).scalar()
    boot = bootstrap_mean(df, value, key).select(F.lit("bootstrap").alias("check"), F.col("relative_width").alias("change"), "robust")
    d = df.where(v.isNotNull()).select(v.alias("v"), col(key).alias("k"))
    n = d.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n * trim)
    kept = with_order(d, "v", "k").where((F.col("_pos") > cut) & (F.col("_pos") <= n - cut)).agg(F.avg("v").alias("m"))
    change = lambda m: F.try_divide(F.abs(m - base), F.abs(base))
    out = boot.unionByName(kept.select(F.lit("trim").alias("check"), change(F.col("m")).alias("change"), (change(F.col("m")) <= tolerance).alias("robust")))
    if group:
        g = df.where(v.isNotNull()).groupBy(col(group).alias("g")).agg(F.sum(v).alias("s"), F.count(F.lit(1)).alias("n"))
        top = g.agg(F.max_by(F.struct("s", "n"), F.struct("n", "g"))).scalar()
        rest = g.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(F.try_divide(F.col("s") - top["s"], F.col("n") - top["n"]).alias("m"))
        ch = change(F.col("m"))
        out = out.unionByName(rest.select(F.lit("largest_group").alias("check"), ch.alias("change"), F.coalesce(ch <= tolerance, F.lit(False)).alias("robust")))
    return out


def rows_to_break_gap(df: DataFrame, value: str, group: str, a, b, key: str, vanish: float = 0.25) -> DataFrame:
    """Fewest rows, taken by influence, whose removal erases or reverses the gap of two means.

    Rows are ordered once by their pull on the gap and removed cumulatively; the first
    prefix that breaks it is reported. (Re-ranking after every removal could do with fewer.)
    """
    v = col(value).cast("double")
    d = df.where(col(group).isin(a, b) & v.isNotNull())
    s = scalar_row(
        d, sa=F.sum(F.when(col(group) == a, v)), na=F.count(F.when(col(group) == a, v)), sb=F.sum(F.when(col(group) == b, v)), nb=F.count(F.when(col(group) == b, v))
    )
    ma, mb = s["sa"] / s["na"], s["sb"] / s["nb"]
    flip = F.when(ma >= mb, 1).otherwise(-1)
    in_a = col(group) == a
    pull = flip * F.when(in_a, (v - ma) / (s["na"] - 1)).otherwise((mb - v) / (s["nb"] - 1))
    x = d.select(
        (-pull).alias("rank"), col(key).alias("k"), F.when(in_a, v).otherwise(0.0).alias("va"), in_a.cast("long").alias("ca"), F.when(in_a, 0.0).otherwise(v).alias("vb"), (~in_a).cast("long").alias("cb"),
    )
    r = with_order(x, "rank", "k", running_sum=["va", "ca", "vb", "cb"])
    left = (F.try_divide(s["sa"] - F.col("run_va"), s["na"] - F.col("run_ca"))) - (F.try_divide(s["sb"] - F.col("run_vb"), s["nb"] - F.col("run_cb")))
    gap = ma - mb
    broken = (F.signum(left) != F.signum(gap)) | (F.abs(left) <= vanish * F.abs(gap))
    hit = r.where(broken).agg(F.min("_pos").alias("rows_to_break"), F.min_by(F.signum(left) != F.signum(gap), F.col("_pos")).alias("reverses"))
    total = s["na"] + s["nb"]
    share = F.col("rows_to_break") / total
    level = F.when(F.col("rows_to_break").isNull(), "robust").when(share <= 0.10, "fragile").when(share <= 0.30, "moderate").otherwise("robust")
    return hit.select(
        gap.alias("gap"), "rows_to_break", total.alias("rows"), share.alias("fraction"), F.when(F.col("reverses"), "reverses").when(F.col("rows_to_break").isNotNull(), "disappears").otherwise("stable").alias("mode"), level.alias("severity")
    )


def fewest_rows_to_break_gap(df: DataFrame, value: str, group: str, a, b, key: str, segments: Sequence[str] = (), vanish: float = 0.25) -> DataFrame:
    """The fewest rows whose removal erases or reverses the gap of two means, and who carries them.

    To lower the higher mean its largest values go first, to raise the lower mean its smallest. With i
    taken from the one side, the least j from the other falls as i grows, so a frontier of one
    (i, j) for each i holds the least i + j: prefix sums in range buckets, and an as-of join of both
    sides' means. Each group keeps a row. ``segment`` is the value of one of ``segments`` that most of
    the rows taken have (``column = value``), ``segment_share`` its part of them; ties by name. Ties of
    i + j go to the least i. Rows without a value play no part; where nothing breaks the gap,
    or a group is empty or there is no gap, ``rows_to_break`` is null.
    """
    v = col(value).cast("double")
    d = df.where(col(group).isin(a, b) & v.isNotNull() & ~F.isnan(v))
    sums = [F.sum(F.when(col(group) == g, v)).alias(f"s{i}") for i, g in enumerate((a, b))] + [F.count(F.when(col(group) == g, v)).alias(f"n{i}") for i, g in enumerate((a, b))]
    t = d.agg(*sums).first()
    spark = df.sparkSession
    schema = "gap double, rows_to_break long, from_higher long, from_lower long, rows long, fraction double, mode string, severity string, segment string, segment_share double"
    if not t.n0 or not t.n1:
        return spark.createDataFrame([(None, None, None, None, t.n0 + t.n1, None, "stable", "robust", None, None)], schema)
    gap = t.s0 / t.n0 - t.s1 / t.n1
    high, low = ((a, t.s0, t.n0), (b, t.s1, t.n1)) if gap >= 0 else ((b, t.s1, t.n1), (a, t.s0, t.n0))

    def side(which: tuple, sign: int) -> DataFrame:
        """The rows of one group in the order they go, with what is left of the mean after each."""
        name, total, n = which
        x = d.where(col(group) == name).select((v * sign).alias("_o"), v.alias("_v"), col(key).alias("_key"), *[col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(segments)])
        x = with_order(x, "_o", "_key", running_sum=["_v"])
        return x.withColumn("_mean", F.when(F.col("_pos") < n, (F.lit(total) - F.col("run__v")) / (F.lit(n) - F.col("_pos"))))

    tops, bottoms = cut_lineage(side(high, -1)), cut_lineage(side(low, 1))
    steps = lambda x, which: x.where("_mean is not null").select(F.col("_pos").alias("k"), F.col("_mean").alias("m")).unionByName(spark.range(0, 1, 1, 1).select(F.lit(0).cast("long").alias("k"), F.lit(which[1] / which[2]).alias("m")))
    left = steps(tops, high).select(F.col("k").alias("i"), (F.col("m") - vanish * abs(gap)).alias("need"))
    right = steps(bottoms, low).groupBy(F.col("m").alias("have")).agg(F.min("k").alias("j"))
    frontier = asof_join(left, right, "need", "have", direction="forward").where("j is not null")
    best = frontier.agg(F.min(F.struct((F.col("i") + F.col("j")).alias("k"), "i", "j")).alias("b")).first().b if gap else None
    n = t.n0 + t.n1
    if best is None:
        return spark.createDataFrame([(gap, None, None, None, n, None, "stable", "robust", None, None)], schema)
    gone = tops.where(F.col("_pos") <= best.i).unionByName(bottoms.where(F.col("_pos") <= best.j))
    out_h, out_l = (x.where(F.col("_pos") <= k).agg(F.coalesce(F.sum("_v"), F.lit(0.0))).first()[0] for x, k in ((tops, best.i), (bottoms, best.j)))
    remains = (high[1] - out_h) / (high[2] - best.i) - (low[1] - out_l) / (low[2] - best.j)
    share = best.k / n
    level = "fragile" if share <= 0.10 else "moderate" if share <= 0.30 else "robust"
    row = spark.createDataFrame([(gap, best.k, best.i, best.j, n, share, "reverses" if remains < 0 else "disappears", level)], schema.split(", segment")[0])
    if not segments:
        return row.select("*", F.lit(None).cast("string").alias("segment"), F.lit(None).cast("double").alias("segment_share"))
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"_g{i}").alias("g")) for i, c in enumerate(segments)])
    counts = gone.select(F.explode(cells).alias("x")).where("x.g is not null").groupBy(F.concat_ws(" = ", "x.c", "x.g").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.min_by(F.struct("segment", "n"), F.struct(-F.col("n"), F.col("segment"))).alias("b"))
    return row.join(most).select(*row.columns, F.col("b.segment").alias("segment"), (F.col("b.n") / best.k).alias("segment_share"))


def robustness_verdict(stress: DataFrame, gap: DataFrame) -> DataFrame:
    """One verdict from the stress tests and the gap test."""
    s = stress.agg(F.count_if(~F.col("robust")).alias("weak_checks"))
    sev = gap.select("severity").scalar()
    word = F.when((F.col("weak_checks") == 0) & (sev != "fragile"), "robust").otherwise("fragile")
    return s.select("weak_checks", sev.alias("gap_severity"), word.alias("verdict"))


def flag_ranking(feedback: DataFrame, features: Sequence[str], label: str, candidates: DataFrame | None = None, l2: float = 0.01) -> DataFrame:
    """Probability that a flag will be accepted, learned from past accept and dismiss actions; null where a feature is missing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pack = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    train = pack.transform(feedback.withColumn("_label", col(label).cast("double")))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=l2, maxIter=50).fit(train)
    rows = candidates if candidates is not None else feedback
    scored = model.transform(pack.transform(rows)).select(*[col(c) for c in rows.columns], vector_to_array("probability")[1].alias("accept_probability"))
    gaps = any_of([col(f).isNull() | F.isnan(col(f).cast("double")) for f in features])
    return scored.unionByName(rows.where(gaps).withColumn("accept_probability", F.lit(None).cast("double")))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    return quantile_map(df, columns, probs)
