"""Profiles: one wide aggregate plus one stacked value-frequency job describe a whole table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import exact_quantiles, sample_skewness
from plumbline.model import col, kind_of, numeric_columns, text_columns
from plumbline.operators.aggregates import duplicate_rows


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, blank_is_null: bool = False) -> DataFrame:
    """Rows ``(column, value, n)`` for all columns in one shuffle, combined on the map side."""
    cols = list(columns) if columns is not None else df.columns
    pairs = []
    for c in cols:
        v = col(c).cast("string")
        if blank_is_null and kind_of(df.schema[c].dataType) == "text":
            v = F.when(F.trim(v) != "", v)
        pairs.append(F.struct(F.lit(c).alias("column"), v.alias("value")))
    long = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k commonest values per column, ties by value. Each task forwards only k rows per column."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    r = value_counts(df, columns).withColumn("rank", F.row_number().over(w).cast("long"))
    return r.where(F.col("rank") <= k)


def _column_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: kind, rows, non-null, min, max, mean, sigma, skew from one wide aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(col(c)).alias(f"nn{i}"))
        if kind_of(df.schema[c].dataType) == "number":
            x = col(c).cast("double")
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"), F.stddev_pop(x).alias(f"sd{i}"), sample_skewness(x).alias(f"sk{i}")]
    s = df.agg(*aggs)
    none = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(columns):
        number = kind_of(df.schema[c].dataType) == "number"
        g = lambda p: F.col(f"{p}{i}") if number else none
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kind_of(df.schema[c].dataType)).alias("kind"), F.col("rows"), F.col(f"nn{i}").alias("non_null"),
                g("mn").alias("min"), g("mx").alias("max"), g("av").alias("mean"), g("sd").alias("sigma"), g("sk").alias("skew"),
            )
        )
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null rate, distinct values, extremes, five commonest values and a 0-100 quality score per column."""
    cols = list(columns) if columns is not None else df.columns
    base = _column_rows(df, cols)
    counts = value_counts(df, cols)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = (
        counts.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("column")
        # at most five per column
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("top_values"))
    )
    # one row per column on both sides: bounded by the schema
    out = base.join(F.broadcast(distinct), "column", "left").join(F.broadcast(top), "column", "left")
    null_rate = F.coalesce(F.try_divide((F.col("rows") - F.col("non_null")).cast("double"), F.col("rows")), F.lit(0.0))
    distinct_n = F.coalesce("distinct_values", F.lit(0))
    score = (
        F.lit(100.0) - null_rate * 50 - F.when(distinct_n == 1, 10).otherwise(0)
        - F.when(F.col("column").rlike(r"(?i)^col\d+$|^field\d+$|^unnamed"), 5).otherwise(0)
        - F.when((F.col("kind") == "text") & (F.try_divide(distinct_n.cast("double"), F.col("rows")) > 0.95), 20).otherwise(0)
        + F.when(F.col("kind") == "date", 5).otherwise(0)
    )
    return out.select(
        "column", "kind", "rows", F.round(null_rate, 6).alias("null_rate"), distinct_n.alias("distinct_values"), "min", "max",
        "top_values", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("long").alias("quality"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distribution fingerprint: summary numbers per column, no rows."""
    cols = list(columns) if columns is not None else df.columns
    cols = [c for c in cols if kind_of(df.schema[c].dataType) in ("number", "text")]
    base = _column_rows(df, cols)
    counts = value_counts(df, cols)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("d"))
    texts = text_columns(df.select(*[col(c) for c in cols]))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = (
        counts.where(F.col("column").isin(texts)).withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("column")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("top"), F.max("n").alias("top_n"))
    )
    out = base.join(F.broadcast(distinct), "column", "left").join(F.broadcast(top), "column", "left")
    div = lambda a, b: F.try_divide(a.cast("double"), b)
    return out.select(
        "column", F.when(F.col("kind") == "number", "numeric").otherwise("categorical").alias("kind"),
        div(F.col("rows") - F.col("non_null"), F.col("rows")).alias("null_rate"), div(F.coalesce("d", F.lit(0)), F.col("non_null")).alias("cardinality"),
        "mean", F.col("sigma").alias("std"), "skew", "min", "max", "top", div(F.col("top_n"), F.col("non_null")).alias("top_prop"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, sigma, p05/p95, share of zeros and negatives, values beyond three sigmas."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    base = _column_rows(df, cols)
    q = exact_quantiles(df, cols, [0.05, 0.5, 0.95]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))]
    )
    # the counts that need mean and sigma read them as one scalar row
    s = df.agg(F.struct(*[x for i, c in enumerate(cols) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))])).scalar()
    tally = df.agg(
        *[
            x
            for i, c in enumerate(cols)
            for x in (
                F.count_if(F.abs(col(c) - s[f"m{i}"]) > 3 * s[f"s{i}"]).alias(f"o{i}"), F.count_if(col(c) == 0).alias(f"z{i}"), F.count_if(col(c) < 0).alias(f"n{i}"),
            )
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outliers"), F.col(f"z{i}").alias("zeros"), F.col(f"n{i}").alias("negatives")) for i, c in enumerate(cols)]
    t = tally.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    out = base.join(F.broadcast(q), "column", "left").join(F.broadcast(t), "column")
    div = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("non_null")), F.lit(0.0))
    return out.select(
        "column", "rows", "non_null", "min", "max", "mean", "sigma", "p05", "median", "p95", "outliers", div("zeros").alias("zero_share"), div("negatives").alias("negative_share")
    )


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, dominant value and share, and whether the column looks like an identifier."""
    cols = list(columns) if columns is not None else text_columns(df)
    rows = df.agg(F.count(F.lit(1))).scalar()
    g = value_counts(df, cols, blank_is_null=True).groupBy("column").agg(
        F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"), F.max(F.struct("n", "value")).alias("a"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
    )
    share = F.col("a.n") / F.col("non_null")
    return g.select(
        "column", rows.alias("rows"), "non_null", "distinct_values", "top_value", F.col("a.n").alias("top_count"), share.alias("top_share"),
        ((F.col("distinct_values") / F.col("non_null") > 0.9) & (F.col("distinct_values") > 20)).alias("id_like"),
    )


def insight_candidates(df: DataFrame, numbers: Sequence[str] | None = None, texts: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Scored findings over a whole table, best first: outliers, skew, zeros, negatives, dominance, correlation, nulls, duplicates."""
    numbers = list(numbers) if numbers is not None else numeric_columns(df)
    texts = list(texts) if texts is not None else text_columns(df)
    row = lambda kind, c, score, value: F.struct(
        F.lit(kind).alias("kind"), (c if isinstance(c, Column) else F.lit(c)).alias("column"), score.cast("double").alias("score"), value.cast("double").alias("value")
    )
    parts = []
    if numbers:
        p = numeric_profile(df, numbers)
        n, c = F.col("non_null"), F.col("column")
        out_share = F.coalesce(F.try_divide(F.col("outliers").cast("double"), n), F.lit(0.0))
        gap = F.coalesce(F.try_divide(F.abs(F.col("mean") - F.col("median")), F.col("sigma")), F.lit(0.0))
        nulls = F.coalesce(F.try_divide((F.col("rows") - n).cast("double"), F.col("rows")), F.lit(0.0))
        kinds = F.array(
            F.when(F.col("outliers") > 0, row("outliers", c, 60 + F.least(F.lit(30.0), out_share * 300), F.col("outliers"))),
            F.when(gap > 0.3, row("skew", c, 45 + F.least(F.lit(25.0), gap * 25), gap)),
            F.when(F.col("zero_share") > 0.3, row("zeros", c, 40 + F.col("zero_share") * 30, F.col("zero_share"))),
            F.when((F.col("negative_share") > 0) & (F.col("negative_share") < 0.2), row("negatives", c, F.lit(55.0), F.col("negative_share"))),
            F.when(nulls > 0.05, row("nulls", c, 50 + nulls * 40, nulls)),
        )
        parts.append(p.select(F.explode(F.array_compact(kinds)).alias("r")).select("r.*"))
        pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
        if pairs:
            s = df.agg(*[F.corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
            rs = [F.when(F.abs(F.col(f"r{i}")) >= 0.75, row("correlation", f"{a} x {b}", 60 + F.abs(F.col(f"r{i}")) * 35, F.col(f"r{i}"))) for i, (a, b) in enumerate(pairs)]
            parts.append(s.select(F.explode(F.array_compact(F.array(*rs))).alias("r")).select("r.*"))
    if texts:
        q = categorical_profile(df, texts)
        kinds = F.array(F.when((F.col("top_share") >= 0.5) & ~F.col("id_like") & (F.col("distinct_values") > 1), row("dominance", F.col("column"), 45 + F.col("top_share") * 40, F.col("top_share"))))
        parts.append(q.select(F.explode(F.array_compact(kinds)).alias("r")).select("r.*"))
    d = duplicate_rows(df)
    parts.append(d.where("extra_rows > 0").select(row("duplicates", "*", F.lit(70.0), F.col("extra_rows")).alias("r")).select("r.*"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    ranked = out.orderBy(F.desc("score"), "kind", "column")
    return ranked if limit is None else ranked.limit(limit)


def concentration(df: DataFrame, category: str, value: str, top: int = 3, threshold: float = 0.5) -> DataFrame:
    """Share of a total carried by the few largest groups."""
    g = df.groupBy(col(category).alias("key")).agg(F.sum(col(value)).alias("v"))
    total = df.agg(F.sum(col(value))).scalar()
    lead = g.orderBy(F.desc("v"), "key").limit(top).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("groups"))
    share = F.try_divide(F.col("v"), total)
    return lead.select(F.lit(category).alias("category"), "groups", share.alias("share"), (share >= threshold).alias("concentrated"))


def preflight(df: DataFrame, age_hours: Column | None = None, fresh_hours: float = 24) -> DataFrame:
    """Rows, columns, columns with nulls, duplicate rows, freshness: one status row each."""
    n_cols = len(df.columns)
    nulls = sum((F.max(col(c).isNull().cast("int")) for c in df.columns), F.lit(0))
    s = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(nulls, F.lit(0)).cast("long").alias("null_cols"))
    s = s.withColumn("dup", duplicate_rows(df).select("extra_rows").scalar())
    row = lambda name, v, st: F.struct(F.lit(name).alias("check"), v.cast("double").alias("value"), st.alias("status"))
    rows = [
        row("rows", F.col("n"), F.when(F.col("n") > 0, "pass").otherwise("fail")),
        row("columns", F.lit(n_cols), F.lit("pass" if n_cols else "fail")),
        row("columns_with_nulls", F.col("null_cols"), F.when(F.col("null_cols") == 0, "pass").when(F.col("null_cols") < n_cols / 2, "warn").otherwise("fail")),
        row("duplicate_rows", F.col("dup"), F.when(F.col("dup") == 0, "pass").otherwise("warn")),
    ]
    if age_hours is not None:
        rows.append(row("freshness_hours", age_hours, F.when(age_hours < fresh_hours, "pass").otherwise("warn")))
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def readiness(df: DataFrame) -> DataFrame:
    """Gate before charts: row count, duplicates over 1 %, empty numbers over 30 %, outliers for information."""
    numbers = numeric_columns(df)
    blank = lambda c: col(c).isNull() if c in numbers else col(c).isNull() | (F.trim(col(c).cast("string")) == "")
    s = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(blank(c)).alias(f"e{i}") for i, c in enumerate(df.columns)])
    s = s.withColumn("dup", duplicate_rows(df).select("extra_rows").scalar())
    n = F.col("n")
    row = lambda check, c, sev, v: F.struct(F.lit(check).alias("check"), F.lit(c).cast("string").alias("column"), sev.alias("severity"), v.cast("double").alias("value"))
    dup = F.coalesce(F.try_divide(F.col("dup").cast("double"), n), F.lit(0.0))
    rows = [
        row("row_count", None, F.when(n == 0, "block").when(n < 30, "warn").otherwise("pass"), n),
        row("duplicates", None, F.when(dup > 0.01, "block").when(dup > 0, "warn").otherwise("pass"), F.round(dup, 6)),
    ]
    for i, c in enumerate(df.columns):
        rate = F.coalesce(F.try_divide(F.col(f"e{i}").cast("double"), n), F.lit(0.0))
        rows.append(row("empty", c, F.when((rate > 0.3) & F.lit(c in numbers), "block").when(rate > 0.1, "warn").otherwise("pass"), F.round(rate, 6)))
    out = s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if numbers:
        from plumbline.plans.layers import outliers

        o = outliers(df, numbers).where(F.col("iqr_low") + F.col("iqr_high") > 0)
        out = out.unionByName(o.select(F.lit("outliers").alias("check"), "column", F.lit("info").alias("severity"), (F.col("iqr_low") + F.col("iqr_high")).cast("double").alias("value")))
    return out
