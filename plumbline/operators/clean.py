"""Issue scan, fixes with audit rows, imputation, format repair, fix scoring, defect injection."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import scalar_row
from plumbline.functions.text import parse_number
from plumbline.model import col, kind_of, matching, numeric_columns, text_columns
from plumbline.operators.aggregates import duplicate_rows
from plumbline.operators.fuzzy import fuzzy_duplicates, is_identifier_name

AMOUNT_NAME = r"amount|count|qty|quantity|price|cost|rate|los|stay"
# Fixed value: names of columns most likely to hold misspelt names.
NAME_LIKE = r"name|title|company|city|address|email|customer|vendor"
# Texts that mean "missing".
FAKE_NULLS = ("null", "n/a", "na", "none", "-", "unknown", "")
DATE_SHAPES = {
    "MM/DD/YYYY": (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    "YYYY-MM-DD": (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    "DD-MM-YYYY": (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    "DD.MM.YYYY": (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
}
CURRENCY_SHAPE = r"^\$?[\d,]+\.?\d*$"


def spelling_column(df: DataFrame) -> str | None:
    """The text column whose values are compared for misspellings: the first with a name-like name, else the first.

    Identifier-like columns are left out: near-equal identifiers are different records.
    """
    names = [c for c in text_columns(df) if not is_identifier_name(c)]
    return next(iter(matching(names, NAME_LIKE) or names), None)


def near_duplicate_pairs(df: DataFrame, column: str, threshold: float = 0.85, metric: str = "both") -> DataFrame:
    """One row ``near``: how many pairs of rows hold unequal values above a similarity.

    Values are counted first, so a pair of values stands for the product of their rows; pairs of rows are never made.
    """
    pairs = fuzzy_duplicates(df, column, threshold, metric)
    return pairs.agg(F.coalesce(F.sum(F.col("rows_a") * F.col("rows_b")), F.lit(0)).alias("near"))


def scan_issues(
    df: DataFrame,
    amount_columns: Sequence[str] | None = None,
    duplicates: bool = True,
    near_duplicates: bool = True,
    threshold: float = 0.85,
    metric: str = "both",
) -> DataFrame:
    """Nulls, padded text, negative amounts, duplicate rows and near-duplicate values with the fixes on offer.

    All column checks run as one aggregate over the table; duplicates need one grouping. Near duplicates are
    sought in ``spelling_column`` and reported as one row without a fix, for review: its count is pairs of rows,
    so it has no share of the rows. ``metric="levenshtein"`` is the choice for very large vocabularies. A table without
    rows, or without a text column that is no identifier, gives no such row.
    """
    checks: list[tuple[str, str, list[str]]] = []
    aggs = [F.count(F.lit(1)).alias("n")]

    def add(kind: str, c: str, condition: Column, fixes: list[str]):
        aggs.append(F.count_if(condition).alias(f"c{len(checks)}"))
        checks.append((kind, c, fixes))

    for f in df.schema.fields:
        number = kind_of(f.dataType) == "number"
        add("nulls", f.name, col(f.name).isNull(), ["drop_rows", "fill_zero", "fill_mean", "fill_mode"] if number else ["drop_rows", "fill_mode"])
    for c in text_columns(df):
        add("whitespace", c, col(c) != F.trim(col(c)), ["trim"])
    amounts = matching(numeric_columns(df), AMOUNT_NAME) if amount_columns is None else amount_columns
    for c in amounts:
        add("negative", c, col(c) < 0, ["drop_rows", "abs_value", "null_out"])
    s = df.agg(*aggs)
    row = lambda kind, c, n, fixes: F.struct(
        F.lit(kind).alias("issue"), F.lit(c).cast("string").alias("column"), n.cast("long").alias("count"),
        F.round(F.try_divide(n, F.col("n")) * 100, 1).alias("pct"), F.array(*[F.lit(x) for x in fixes]).cast("array<string>").alias("fixes"),
    )
    rows = [row(k, c, F.col(f"c{i}"), fx) for i, (k, c, fx) in enumerate(checks)]
    if duplicates:
        s = s.withColumn("dup", duplicate_rows(df).select("extra_rows").scalar())
        rows.append(row("duplicates", None, F.col("dup"), ["dedupe"]))
    fuzzy = spelling_column(df) if near_duplicates else None
    if fuzzy is not None:
        s = s.withColumn("near", near_duplicate_pairs(df, fuzzy, threshold, metric).scalar())
        rows.append(row("fuzzy_duplicates", fuzzy, F.col("near"), []).withField("pct", F.lit(None).cast("double")))
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("count") > 0)


def mode_value(df: DataFrame, column: str) -> Column:
    """Most frequent value, ties by value, as a scalar: groups first, then one max."""
    g = df.where(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).scalar()


def apply_fix(df: DataFrame, issue: str, column: str | None, fix: str) -> tuple[DataFrame, DataFrame]:
    """The fixed table and one audit row ``(issue, column, fix, rows_affected)``."""
    c = col(column) if column else None
    hit = {"nulls": lambda: c.isNull(), "whitespace": lambda: c != F.trim(c), "negative": lambda: c < 0}.get(issue)
    if issue == "duplicates":
        fixed = df.dropDuplicates()
        count = duplicate_rows(df).select(F.col("extra_rows").alias("rows_affected"))
    else:
        count = df.agg(F.count_if(hit()).alias("rows_affected"))
        if fix == "drop_rows":
            fixed = df.where(~F.coalesce(hit(), F.lit(False)))
        else:
            dtype = df.schema[column].dataType
            value = {
                "fill_zero": lambda: F.coalesce(c, F.lit(0).cast(dtype)),
                "fill_mean": lambda: F.coalesce(c.cast("double"), df.agg(F.avg(c)).scalar()),
                "fill_mode": lambda: F.coalesce(c, mode_value(df, column)),
                "trim": lambda: F.trim(c),
                "abs_value": lambda: F.abs(c),
                "null_out": lambda: F.when(~(c < 0), c),
            }[fix]()
            fixed = df.withColumn(column, value)
    audit = count.select(F.lit(issue).alias("issue"), F.lit(column).cast("string").alias("column"), F.lit(fix).alias("fix"), "rows_affected")
    return fixed, audit


def impute_group_mean(df: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Add ``<target>_imputed``: the value, else its group's mean, else the overall mean.

    Group means come from a combined aggregate joined back null-safely, so a group with a
    third of the rows stays spread over tasks (a window would sort it in one).
    """
    means = df.where(col(target).isNotNull()).groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.avg(col(target)).alias("_m"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & col(k).eqNullSafe(F.col(f"_k{i}"))
    overall = df.agg(F.avg(col(target))).scalar()
    out = df.join(means, on, "left").withColumn(f"{target}_imputed", F.coalesce(col(target).cast("double"), "_m", overall))
    return out.drop("_m", *[f"_k{i}" for i in range(len(keys))])


def impute_preview(df: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    d = impute_group_mean(df, target, keys)
    missing, left = col(target).isNull(), F.col(f"{target}_imputed").isNull()
    return d.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(missing).alias("null_count"),
        F.count_if(missing & ~left).alias("would_fill"), F.count_if(left).alias("remaining"),
    )


def scan_formats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Currency text, mixed date formats and fake nulls per text column, counted over all rows."""
    cols = list(columns) if columns else text_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        t = F.trim(col(c))
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count_if(t.rlike(CURRENCY_SHAPE)).alias(f"cur{i}"),
                 F.count_if(t.rlike(CURRENCY_SHAPE) & t.rlike(r"[$,]")).alias(f"sym{i}"),
                 F.count_if(F.lower(t).isin(*FAKE_NULLS)).alias(f"fake{i}")]
        aggs += [F.count_if(t.rlike(rx)).alias(f"d{i}_{j}") for j, (rx, _) in enumerate(DATE_SHAPES.values())]
    rows = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}")
        kinds = sum((F.when(F.col(f"d{i}_{j}") > 0, 1).otherwise(0) for j in range(len(DATE_SHAPES))), F.lit(0))
        dated = sum((F.col(f"d{i}_{j}") for j in range(len(DATE_SHAPES))), F.lit(0))
        rows += [
            F.struct(F.lit(c).alias("column"), F.lit("currency_text").alias("issue"), F.col(f"cur{i}").alias("count"),
                     ((F.col(f"cur{i}") / n > 0.7) & (F.col(f"sym{i}") > 0)).alias("found")),
            F.struct(F.lit(c).alias("column"), F.lit("mixed_dates").alias("issue"), dated.cast("long").alias("count"), (kinds >= 2).alias("found")),
            F.struct(F.lit(c).alias("column"), F.lit("fake_null").alias("issue"), F.col(f"fake{i}").alias("count"), (F.col(f"fake{i}") > 0).alias("found")),
        ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("found").drop("found")


def fix_currency(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_num", parse_number(col(column)))


def fix_dates(df: DataFrame, column: str) -> DataFrame:
    t = F.trim(col(column))
    parsed = [F.when(t.rlike(rx), F.try_to_timestamp(t, F.lit(fmt)).cast("date")) for rx, fmt in DATE_SHAPES.values()]
    return df.withColumn(f"{column}_date", F.coalesce(*parsed))


def fix_fake_nulls(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(~F.lower(F.trim(col(column))).isin(*FAKE_NULLS), col(column)))


def uncertain_imputations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How doubtful a mean or mode fill would be, for every column with nulls.

    Numbers: min(1, variation / 2). Text: 1 - margin between the two commonest values.
    """
    cols = list(columns) if columns else df.columns
    numbers = [c for c in cols if kind_of(df.schema[c].dataType) == "number"]
    texts = [c for c in cols if c not in numbers]
    aggs = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        if c in numbers:
            aggs += [F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}")]
    s = df.agg(*aggs)
    if texts:
        pairs = [F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in texts]
        freq = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        lead = freq.groupBy("c").agg(F.max(F.struct("n", "v")).alias("a"))
        second = freq.join(lead, "c").where(F.col("v") != F.col("a.v")).groupBy("c").agg(F.max("n").alias("b"))
        # one row per text column: bounded by the schema
        tops = lead.join(second, "c", "left").select("c", F.col("a.n").alias("top"), F.coalesce("b", F.lit(0)).alias("next"))
    rows = []
    for i, c in enumerate(cols):
        cv = F.abs(F.try_divide(F.col(f"s{i}"), F.col(f"m{i}"))) if c in numbers else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.when(cv.isNotNull(), F.least(F.lit(1.0), cv / 2)).alias("num")))
    out = s.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("nulls > 0")
    if texts:
        out = out.join(F.broadcast(tops), F.col("column") == F.col("c"), "left")
        margin = 1 - F.try_divide((F.col("top") - F.col("next")).cast("double"), F.col("top") + F.col("next"))
        out = out.withColumn("num", F.coalesce("num", margin))
    return out.where(F.col("num").isNotNull()).select("column", "nulls", F.round("num", 4).alias("uncertainty"))


def fix_confidence(issues: DataFrame) -> DataFrame:
    """Score 0-100 and label for each ``(issue, column, fix, pct, cv, mode_share)`` row."""
    fix, name = F.col("fix"), F.lower(F.coalesce("column", F.lit("")))
    cv, share, pct = F.col("cv"), F.col("mode_share"), F.col("pct")
    score = (
        F.when(fix == "trim", 96).when(fix == "dedupe", 90).when(fix == "abs_value", 55).when(fix == "null_out", 65)
        .when(fix == "fill_zero", F.when(name.rlike("count|qty|quantity"), 70).otherwise(45))
        .when(fix == "fill_mean", F.when(cv.isNull(), 55).when(cv < 0.25, 80).when(cv < 0.75, 60).otherwise(45))
        .when(fix == "fill_mode", F.when(share.isNull(), 55).when(share >= 0.8, 88).when(share >= 0.5, 65).otherwise(42))
        .when(fix == "drop_rows", F.when(pct < 1, 70).otherwise(50))
        .otherwise(55)
    )
    label = F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")
    return issues.withColumns({"score": score.cast("long"), "confidence": label})


def material_issues(issues: DataFrame, threshold_pct: float = 1.0) -> DataFrame:
    """Keep issues touching at least the threshold share; an unknown share is kept."""
    return issues.where(F.col("pct").isNull() | (F.col("pct") >= threshold_pct))


def _chosen(key: Column, seed: int, tag: str, rate: float) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(f"{seed}:{tag}")), F.lit(1_000_000)) < int(rate * 1_000_000)


def inject_defects(
    df: DataFrame, key: str, missing: dict[str, float] | None = None, outliers: dict[str, float] | None = None,
    drift: dict[str, float] | None = None, duplicates: float = 0.0, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Plant defects at given rates; returns the table and a manifest ``(kind, column, rate, count)``.

    Rows are picked by a hash of the key and seed: the same rows on any partitioning.
    """
    k = col(key)
    changes, marks = {}, []
    for kind, spec in (("missing", missing), ("outlier", outliers), ("drift", drift)):
        for c, rate in (spec or {}).items():
            here = changes.get(c, col(c))
            pick = _chosen(k, seed, f"{kind}:{c}", rate)
            if kind == "missing":
                changes[c] = F.when(pick, None).otherwise(here)
            elif kind == "outlier":
                top = df.agg(F.max(F.abs(col(c)))).scalar()
                changes[c] = F.when(pick, top.cast("double") * 1000 + 1e6).otherwise(here)
            else:
                pick = pick & (F.coalesce(col(c), F.lit("")) != "")
                changes[c] = F.when(pick, F.concat(col(c), F.lit("_drift"))).otherwise(here)
            marks.append((kind, c, rate, F.count_if(pick)))
    twice = _chosen(k, seed, "duplicate", duplicates)
    marks.append(("duplicate", None, duplicates, F.count_if(twice)))
    out = df.withColumns(changes) if changes else df
    out = out.withColumn("_copies", F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = out.withColumn("_copy", F.explode("_copies")).drop("_copies", "_copy")
    s = df.agg(*[m[3].alias(f"m{i}") for i, m in enumerate(marks)])
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(c).cast("string").alias("column"), F.lit(rate).alias("rate"), F.col(f"m{i}").alias("count")) for i, (kind, c, rate, _) in enumerate(marks)]
    return out, s.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("rate > 0")
