"""Grouped aggregates, pivots, cross-tabs, spreadsheet formulas, metrics and chart feeds."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import with_order
from plumbline.functions.stats import exact_quantiles, scalar_row
from plumbline.functions.text import bigram_dice
from plumbline.operators.privacy import uniform
from plumbline.model import Dataset, col, matching, numeric_columns

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


def group_aggregate(df: DataFrame, key: str, value: str, how: str = "sum", blank: str = "(blank)") -> DataFrame:
    """One aggregate per group; missing and empty keys share one label, non-numbers are skipped."""
    k = F.trim(col(key).cast("string"))
    k = F.when(k.isNull() | (k == ""), F.lit(blank)).otherwise(k)
    if how == "count":
        agg = F.count(F.lit(1))
    else:
        agg = AGGREGATES[how](col(value).cast("string").try_cast("double") if df.schema[value].dataType.simpleString() == "string" else col(value).cast("double"))
    return df.groupBy(k.alias("key")).agg(agg.alias("value"), F.count(F.lit(1)).alias("rows"))


def pivot_cardinality(df: DataFrame, column: str) -> int:
    """Number of distinct pivot values."""
    return df.select(col(column)).distinct().count()


def pivot(
    df: DataFrame, rows: Sequence[str], column: str | None, value: str, how: str, values: Sequence | None = None
) -> DataFrame:
    """Group-by, or a pivot when ``column`` is given: one column for each of ``values``, by default of all values.

    Where the values are too many for columns, ``pivot_long`` gives the same cells as rows.
    """
    grouped = df.groupBy(*[col(r) for r in rows])
    agg = AGGREGATES[how](col(value))
    if column is None:
        return grouped.agg(agg.alias(f"{how}_{value}"))
    if values is None:
        values = [r[0] for r in df.select(col(column)).distinct().orderBy(col(column)).collect()]  # the result's columns
    return grouped.pivot(column, list(values)).agg(agg)


def pivot_long(df: DataFrame, rows: Sequence[str], column: str, value: str, how: str) -> DataFrame:
    """The cells of a pivot as rows ``(rows, column, value)``, for any number of pivot values."""
    return df.groupBy(*[col(r) for r in rows], col(column)).agg(AGGREGATES[how](col(value)).alias("value"))


def crosstab(df: DataFrame, row: str, column: str, value: str, how: str = "sum") -> DataFrame:
    """Long cross-tab with row totals, column totals and the grand total in one cube."""
    g = F.grouping_id()
    level = F.when(g == 0, "cell").when(g == 1, "row_total").when(g == 2, "column_total").otherwise("grand_total")
    return (
        df.cube(col(row).alias("row_key"), col(column).alias("column_key"))
        .agg(AGGREGATES[how](col(value)).alias("value"), F.count(F.lit(1)).alias("rows"), level.alias("level"))
    )


def formula(name: str, column: str, op: str = "=", operand=None, over: str | None = None) -> Column:
    """A spreadsheet formula as an aggregate Column (case-insensitive name)."""
    c = col(column)
    compare = {
        "=": lambda a, b: a == b,
        "<>": lambda a, b: a != b,
        ">": lambda a, b: a > b,
        "<": lambda a, b: a < b,
        ">=": lambda a, b: a >= b,
        "<=": lambda a, b: a <= b,
    }
    hit = compare[op](c, F.lit(operand)) if operand is not None else F.lit(False)
    target = col(over) if over else c
    table = {
        "SUM": lambda: F.sum(c),
        "AVERAGE": lambda: F.avg(c),
        "COUNT": lambda: F.count(c),
        "COUNTA": lambda: F.count(c),
        "COUNTBLANK": lambda: F.count_if(c.isNull()),
        "COUNTIF": lambda: F.count_if(hit),
        "SUMIF": lambda: F.sum(F.when(hit, target)),
        "AVERAGEIF": lambda: F.avg(F.when(hit, target)),
        "MAX": lambda: F.max(c),
        "MIN": lambda: F.min(c),
        "STDEV": lambda: F.stddev(c),
        "STDEVP": lambda: F.stddev_pop(c),
        "VAR": lambda: F.variance(c),
        "VARP": lambda: F.var_pop(c),
        "MEDIAN": lambda: F.median(c),
        "DISTINCTCOUNT": lambda: F.count_distinct(c),
        "MODE": lambda: F.mode(c, True),
        "PRODUCT": lambda: F.product(c),
    }
    key = name.strip().upper()
    if key not in table:
        raise ValueError(f"unsupported formula {name}")
    return table[key]()


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a row's values and which of them are null: what is shuffled in place of whole rows."""
    cells = [col(c) for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(gaps, *cells).alias("_h1"), F.xxhash64(F.lit(1), gaps, *cells).alias("_h2")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row, and how many distinct rows repeat."""
    g = df.groupBy(*row_digest(df)).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1)), F.lit(0)).alias("extra_rows"),
        F.count_if(F.col("_c") > 1).alias("duplicate_groups"),
    )


# Fixed value: names of business keys.
BUSINESS_KEY = r"^(id|key|code)$|(_id|_key|_code|_no|_num|_number)$"


def business_key_duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Keys repeated by rows that are not all identical.

    Identical rows collapse first; the second level only counts distinct rows per key.
    """
    keys = list(keys) if keys else matching(df.columns, BUSINESS_KEY)
    rest = [c for c in df.columns if c not in keys]
    if not keys or not rest:
        raise ValueError("needs key columns and at least one other column")
    rows = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    per = rows.groupBy(*[col(c) for c in keys]).agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"))
    bad = F.col("_d") > 1
    return per.agg(
        F.count_if(bad).alias("key_groups"), F.coalesce(F.sum(F.when(bad, F.col("_c") - 1)), F.lit(0)).alias("extra_rows")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column: exact by one stacked group-by, or by sketches without a shuffle of values."""
    if approximate:
        s = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(columns)]
        return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    pairs = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in columns]
    seen = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").distinct()
    return seen.groupBy("column").agg(F.count("v").alias("distinct_values"))


def two_path_agreement(df: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Group sums taken directly and through a salted two-level aggregate must agree."""
    direct = df.groupBy(col(key).alias("grp")).agg(F.sum(col(value)).alias("direct"))
    salt = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(16))
    parts = df.groupBy(col(key).alias("grp"), salt.alias("_s")).agg(F.sum(col(value)).alias("p"))
    staged = parts.groupBy("grp").agg(F.sum("p").alias("staged"))
    j = direct.join(staged.withColumnRenamed("grp", "g2"), F.col("grp").eqNullSafe(F.col("g2")), "full")
    off = F.abs(F.coalesce("direct", F.lit(0.0)) - F.coalesce("staged", F.lit(0.0)))
    scale = F.greatest(F.lit(1.0), F.abs(F.coalesce("direct", F.lit(0.0))))
    return j.agg(F.count(F.lit(1)).alias("groups"), F.count_if(off > tolerance * scale).alias("mismatches")).withColumn(
        "status", F.when(F.col("mismatches") > 0, "fail").otherwise("pass")
    )


# Fixed value: names of amounts that may not be negative.
AMOUNT_NAME = r"amount|count|qty|quantity|price|cost|rate|age|salary|revenue"


def quality_signals(ds: Dataset, as_of: Column, out_of_range: Sequence[str] | None = None) -> DataFrame:
    """Missingness, out-of-range, duplicate rate and hours since load."""
    df = ds.df
    amounts = list(out_of_range) if out_of_range is not None else matching(numeric_columns(df), AMOUNT_NAME)
    nulls = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    low = sum((F.count_if(col(c) < 0) for c in amounts), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls"), low.alias("low"))
    extra = duplicate_rows(df).select("extra_rows").scalar()
    n = F.col("n")
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0)), 4)
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(F.lit(ds.loaded_at))) / 3600.0
    return base.select(
        share(F.col("nulls"), n * len(df.columns)).alias("missingness_rate"),
        share(F.col("low"), n).alias("out_of_range_rate"),
        share(extra, n).alias("duplicate_rate"),
        F.round(hours, 2).alias("freshness_hours"),
    )


def entity_baseline(df: DataFrame, entity: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*[col(e) for e in entity]).agg(
        F.avg(col(value)).alias("mean"), F.stddev_pop(col(value)).alias("sigma"), F.count(col(value)).alias("n")
    )


@dataclass(frozen=True)
class Metric:
    """A named aggregate with the columns it needs."""

    name: str
    expression: str
    requires: tuple[str, ...] = ()
    status: str = "draft"
    owner: str = ""


def _pct(condition: str) -> str:
    return f"round(count_if({condition}) * 100.0D / nullif(count(*), 0), 2)"


# The metric library.
METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("readmission_rate_30d_pct", _pct("readmit_30d = 1"), ("readmit_30d",)),
        Metric("denial_rate_pct", _pct("claim_status = 'DENIED'"), ("claim_status",)),
        Metric("avg_length_of_stay_days", "round(avg(datediff(discharge_date, admit_date)), 2)", ("admit_date", "discharge_date")),
        Metric("case_mix_index", "round(avg(drg_weight), 4)", ("drg_weight",)),
        Metric("mortality_rate_pct", _pct("discharge_disposition = 'EXPIRED' or deceased = 1"), ("discharge_disposition", "deceased")),
        Metric("ed_utilization_rate_pct", _pct("admit_source = 'EMERGENCY' or emergency_admit = 1"), ("admit_source", "emergency_admit")),
        Metric("net_payment_rate_pct", "round(sum(payment_amount) * 100.0D / nullif(sum(billed_amount), 0), 2)", ("payment_amount", "billed_amount")),
        Metric("row_count", "count(*)"),
    )
}


def null_rate_metric(column: str) -> Metric:
    return Metric("null_rate_pct", _pct(f"`{column}` is null"), (column,))


def distinct_count_metric(column: str) -> Metric:
    return Metric("distinct_count", f"count(distinct `{column}`)", (column,))


def evaluate_metrics(df: DataFrame, metrics: Sequence[Metric], group_by: Sequence[str] = ()) -> DataFrame:
    """All applicable metrics in one aggregate; metrics with absent columns are skipped."""
    usable = [m for m in metrics if set(m.requires) <= set(df.columns)]
    if not usable:
        raise ValueError("no metric applies to these columns")
    return df.groupBy(*[col(g) for g in group_by]).agg(*[F.expr(m.expression).alias(m.name) for m in usable])


def top_groups(df: DataFrame, key: str, value: str | None = None, how: str = "sum", n: int = 10, bottom: bool = False) -> DataFrame:
    """Top or bottom groups by an aggregate, ties broken by key."""
    agg = F.count(F.lit(1)) if how == "count" or value is None else AGGREGATES[how](col(value))
    g = df.groupBy(col(key).alias("key")).agg(agg.alias("value"), F.count(F.lit(1)).alias("rows"))
    by = F.asc("value") if bottom else F.desc("value")
    return g.orderBy(by, F.asc("key")).limit(n)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Rows and share of every group."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("share", F.col("rows") / total)


def missing_by_column(df: DataFrame, blank_is_null: bool = True) -> DataFrame:
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        bad = c.isNull() | (F.trim(c) == "") if blank_is_null and f.dataType.simpleString() == "string" else c.isNull()
        aggs.append(F.count_if(bad).alias(f"m{i}"))
    s = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col("n").alias("rows")) for i, c in enumerate(df.columns)]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe_number(df: DataFrame, column: str) -> DataFrame:
    c = col(column)
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"))


def trend(df: DataFrame, date: str, value: str, how: str = "sum", grain: str = "month") -> DataFrame:
    period = F.date_trunc(grain, col(date)).cast("date")
    agg = F.count(F.lit(1)) if how == "count" else AGGREGATES[how](col(value))
    return df.where(col(date).isNotNull()).groupBy(period.alias("period")).agg(agg.alias("value"))


def bar_feed(df: DataFrame, x: str, y: str | None = None, n: int = 25) -> DataFrame:
    agg = F.avg(col(y)) if y else F.count(F.lit(1))
    g = df.groupBy(col(x).cast("string").alias("x")).agg(agg.alias("y"))
    return g.orderBy(F.desc("y"), F.asc("x")).limit(n)


def pie_feed(df: DataFrame, x: str, n: int = 12, rest: str = "other") -> DataFrame:
    """Counts of the ``n`` most frequent values and of all others together."""
    top = bar_feed(df, x, None, n)
    others = df.agg(F.count(F.lit(1)).alias("y")).crossJoin(top.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("s")))  # one row each
    return top.unionByName(others.select(F.lit(rest).alias("x"), (F.col("y") - F.col("s")).alias("y")).where("y > 0"))


def line_feed(df: DataFrame, x: str, y: str) -> DataFrame:
    """The mean at every point of the line."""
    return df.groupBy(col(x).alias("x")).agg(F.avg(col(y)).alias("y")).orderBy("x")


def scatter_feed(df: DataFrame, x: str, y: str, key: str, n: int = 5000, seed: int = 7) -> DataFrame:
    """A fixed-size sample for drawing, chosen by hash so it does not depend on row order."""
    h = F.md5(F.concat_ws(":", col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    picked = df.where(col(x).isNotNull() & col(y).isNotNull()).select(col(x).alias("x"), col(y).alias("y"), h.alias("_h"))
    return picked.orderBy("_h", "x", "y").limit(n).select("x", "y")


def box_feed(df: DataFrame, column: str) -> DataFrame:
    """Five-number summary with Tukey whisker ends, from exact quantiles."""
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75])
    p = q.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == v, F.col("value"))).alias(n) for n, v in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    )
    s = scalar_row(df, lo=F.min(col(column)).cast("double"), hi=F.max(col(column)).cast("double"))
    iqr = F.col("q3") - F.col("q1")
    return p.select(
        "column", "q1", "median", "q3",
        F.greatest(s["lo"], F.col("q1") - 1.5 * iqr).alias("whisker_low"),
        F.least(s["hi"], F.col("q3") + 1.5 * iqr).alias("whisker_high"),
    )


def histogram(df: DataFrame, column: str, max_bins: int = 20) -> DataFrame:
    """Equal-width bins, ceil(sqrt(n)) of them but at most ``max_bins``."""
    c = col(column).cast("double")
    s = scalar_row(df.where(c.isNotNull()), n=F.count(F.lit(1)), lo=F.min(c), hi=F.max(c))
    bins = F.least(F.lit(max_bins), F.ceil(F.sqrt(s["n"])).cast("int"))
    width = (s["hi"] - s["lo"]) / bins
    idx = F.least(bins - 1, F.floor(F.try_divide(c - s["lo"], width)).cast("int"))
    b = df.where(c.isNotNull()).groupBy(F.coalesce(idx, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    return b.select("bin", "rows", (s["lo"] + F.col("bin") * width).alias("bin_low"))


def downsample(df: DataFrame, date: str, value: str, key: str, points: int = 60) -> DataFrame:
    """Every k-th row in date order, k = max(1, floor(n / points))."""
    d = df.where(col(date).isNotNull() & col(value).isNotNull()).select(col(date).alias("d"), col(value).alias("v"), col(key).alias("k"))
    n = d.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1), F.floor(n / points))
    return with_order(d, "d", "k").where(F.pmod(F.col("_pos") - 1, step) == 0).select("d", "v", F.col("_pos").alias("position"))


def kpis(df: DataFrame, column: str, order: str, key: str) -> DataFrame:
    """Total, mean, extremes, the last twelve values and second-half against first-half change."""
    d = df.where(col(column).isNotNull()).select(col(column).cast("double").alias("v"), col(order).alias("o"), col(key).alias("k"))
    n = d.agg(F.count(F.lit(1))).scalar()
    p = with_order(d, "o", "k")
    first = F.col("_pos") <= F.floor(n / 2)
    s = p.agg(
        F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count("v").alias("n"), F.avg(F.when(first, F.col("v"))).alias("a"), F.avg(F.when(~first, F.col("v"))).alias("b"),
        # at most twelve values by construction
        F.sort_array(F.collect_list(F.when(F.col("_pos") > n - 12, F.struct("_pos", "v")))).alias("tail"),
    )
    delta = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.abs("a")), F.lit(0.0))
    return s.select(F.lit(column).alias("column"), "total", "mean", "min", "max", "n", delta.alias("delta"), F.transform("tail", lambda x: x["v"]).alias("last12"))


def auto_charts(df: DataFrame, category: str, number: str, date: str) -> DataFrame:
    """The three default charts as one long feed: mean by category, counts, monthly mean."""
    mean = df.groupBy(col(category).cast("string").alias("x")).agg(F.avg(col(number)).alias("y")).withColumn("chart", F.lit("mean_by_category"))
    count = df.groupBy(col(category).cast("string").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y")).withColumn("chart", F.lit("count_by_category"))
    month = trend(df, date, number, "avg").select(F.col("period").cast("string").alias("x"), F.col("value").alias("y"), F.lit("monthly_mean").alias("chart"))
    return mean.unionByName(count).unionByName(month).select("chart", "x", "y")


def weighted_vector_mean(
    df: DataFrame, vector: str, weight: str | None = None, clip: float | None = None, min_cohort: int = 1,
    noise_sigma: float = 0.0, key: str | None = None, secret: str = "",
) -> DataFrame:
    """Weighted mean per vector position: rows ``(position, mean, cohort)``.

    Optional L2 clipping per vector and Gaussian noise drawn from a digest of
    ``secret`` and the key, so a retried task draws the same noise and no reader can recompute it. Below ``min_cohort`` the means are null.
    """
    v = col(vector).cast("array<double>")
    if clip is not None:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        v = F.when(norm > clip, F.transform(v, lambda x: x * clip / norm)).otherwise(v)
    w = F.greatest(F.lit(1.0), col(weight).cast("double")) if weight else F.lit(1.0)
    cohort = df.agg(F.count(F.lit(1))).scalar()
    noise_key = col(key) if key else F.lit(0)
    cells = df.select(w.alias("w"), noise_key.alias("k"), F.posexplode(v).alias("position", "x"))
    if noise_sigma:
        u = lambda draw: uniform(secret, F.col("k"), F.col("position"), F.lit(draw))
        gauss = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
        cells = cells.withColumn("x", F.col("x") + noise_sigma * gauss)
    out = cells.groupBy("position").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    return out.select(F.col("position").cast("long").alias("position"), F.when(cohort >= min_cohort, F.col("mean")).alias("mean"), cohort.alias("cohort"))


def claim_grade(n: Column, missing: Column) -> tuple[Column, Column]:
    """Confidence score 0-100 and letter for a claim resting on n values."""
    coverage = F.least(F.lit(1.0), n / 200)
    nulls = 1 - F.least(F.lit(1.0), missing * 4)
    size = F.when(n >= 100, 1.0).when(n >= 30, 0.7).otherwise(0.35)
    score = F.round(100 * (coverage * 0.3 + nulls * 0.3 + size * 0.4)).cast("long")
    return score, F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")


def result_claims(df: DataFrame, number: str, category: str) -> DataFrame:
    """Claims about a result: its size, a mean and the dominant category, each with a grade."""
    top = top_groups(df.where(col(category).isNotNull()), category, None, "count", 1)
    lead = top.select(F.struct(F.col("key").cast("string").alias("key"), "rows")).scalar()
    s = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(col(number)).alias("nn"), F.avg(col(number)).alias("mean"), F.count(col(category)).alias("nc")
    )

    def row(kind, column, value, label, n):
        missing = F.coalesce(F.try_divide((F.col("n") - n).cast("double"), F.col("n")), F.lit(0.0))
        score, grade = claim_grade(n, missing)
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column"), value.cast("double").alias("value"),
            label.cast("string").alias("label"), n.alias("n"), F.round(missing, 6).alias("missing_rate"), score.alias("score"), grade.alias("grade"),
        )

    none = F.lit(None)
    rows = [
        row("rowcount", None, F.col("n"), none, F.col("n")),
        row("numeric_mean", number, F.round("mean", 4), none, F.col("nn")),
        row("category_share", category, F.round(lead["rows"] / F.col("n") * 100, 1), lead["key"], F.col("nc")),
    ]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def grouping_sets(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], mode: str = "rollup") -> DataFrame:
    grouped = df.rollup(*keys) if mode == "rollup" else df.cube(*keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()])


def near_descriptions(metrics: DataFrame, name: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Pairs of metrics whose descriptions have a bigram Dice of ``threshold`` or more: rows ``(a, b, similarity)``.

    Exact: a qualifying pair shares ``t / (2 - t)`` of either side's bigrams, so it shares one among
    the rarest of each, on which they are joined.
    """
    squash = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", ""))
    m = metrics.select(col(name).alias("k"), col(text).alias("w"), squash.alias("s")).distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2)))
    t = m.withColumn("g", F.when(F.length("s") > 1, grams).otherwise(F.array(F.col("s"))))
    # repeated bigrams are numbered, which makes the multiset a set
    numbered = F.transform("g", lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(F.col("g"), F.lit(1), i + 1), lambda e: e == g)).alias("i")))
    t = t.select("k", "w", F.explode(numbered).alias("g"))
    often = t.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sets = t.join(often, "g").groupBy("k", "w").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("g"))
    size = F.size("g")
    head = F.slice("g", F.lit(1), (size - F.ceil(size * (threshold / (2 - threshold)) - 1e-9) + 1).cast("int"))
    index = sets.select("k", "w", F.explode(head).alias("h")).select("k", "w", "h.g")
    left, right = index.select("g", F.col("k").alias("a"), F.col("w").alias("wa")), index.select("g", F.col("k").alias("b"), F.col("w").alias("wb"))
    pairs = left.join(right, "g").where(F.col("a") < F.col("b")).select("a", "b", "wa", "wb").distinct()
    return pairs.withColumn("similarity", bigram_dice(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
