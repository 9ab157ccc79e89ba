"""Validation layers over one table. Each returns findings or small result rows; none collects rows."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import with_order
from plumbline.functions.stats import quantile_map
from plumbline.functions.text import cpt_shaped, icd10_shaped, leading_digit, npi_valid
from plumbline.model import col, finding, kind_of, matching, numeric_columns, stack_structs, text_columns
from plumbline.operators.aggregates import business_key_duplicates, duplicate_rows
from plumbline.operators.joins import near_duplicates
from plumbline.operators.windows import split_half
from plumbline.plans.checks import name_tokens
from plumbline.plans.scans import Each, Part, scan
from plumbline.session import tasks

# Words that mark amount and date columns.
AMOUNT_NAME = r"amount|price|cost|charge|salary|revenue|count|qty|quantity"
DATE_NAME = r"date|admit|discharge"


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


# ---- unit tests and table-level layers ----------------------------------------------


def unit_tests_part(df: DataFrame, key: str | None = None, as_of: Column | None = None) -> Part:
    """Negatives, future dates, blank keys and null references as a share of a scan."""
    key = key or df.columns[0]
    today = as_of if as_of is not None else F.current_date()
    numbers = numeric_columns(df)
    dates = [c for c in df.columns if kind_of(df.schema[c].dataType) == "date" or (kind_of(df.schema[c].dataType) == "text" and re.search(DATE_NAME, c, re.I))]
    refs = [c for c in df.columns if re.search(r"_id$", c, re.I) and c != key]
    wants = {"n": F.count(F.lit(1)), "bk": F.count_if(col(key).isNull())}
    wants |= {f"neg{i}": F.count_if(col(c) < 0) for i, c in enumerate(numbers)}
    wants |= {f"ref{i}": F.count_if(col(c).isNull()) for i, c in enumerate(refs)}
    for i, c in enumerate(dates):
        d = col(c).cast("date") if kind_of(df.schema[c].dataType) == "date" else col(c).try_cast("date")
        wants |= {f"dn{i}": F.count(d), f"df{i}": F.count_if(d > today), f"dd{i}": F.count_if(d > F.add_months(today, 240))}

    def tell(at):
        row = lambda rule, c, v, detail="": _unit_finding(rule, [c], v, at("n"), detail)
        out = [row("blank_key", key, at("bk"))]
        out += [row("negative", c, at(f"neg{i}")) for i, c in enumerate(numbers)]
        out += [row("null_ref", c, at(f"ref{i}")) for i, c in enumerate(refs)]
        return out + [row("future_date", c, at(f"df{i}"), F.round(_share(at(f"dd{i}"), at(f"dn{i}")), 4)) for i, c in enumerate(dates)]

    return Part(wants, tell)


def _unit_finding(rule: str, columns: Sequence[str], v: Column, n: Column, detail: Column | str = "") -> Column:
    return finding("unit_tests", rule, columns, F.when(v > 0, "fail").otherwise("pass"), "hard", v, F.round(_share(v, n), 6), detail)


def duplicate_finding(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row, as a finding."""
    s = duplicate_rows(df).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    return stack_structs(s, [_unit_finding("duplicate", [], F.col("extra_rows"), F.col("n"))])


def unit_tests(df: DataFrame, key: str | None = None, as_of: Column | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Negatives, future dates (with far-future share), blank keys, null references, duplicates."""
    found = scan(df, unit_tests_part(df, key, as_of)).unionByName(duplicate_finding(df))
    if keys:
        s = business_key_duplicates(df, keys).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
        found = found.unionByName(stack_structs(s, [_unit_finding("business_key_duplicate", list(keys), F.col("extra_rows"), F.col("n"))]))
    return found.where(F.col("count") > 0)


def confidence(df: DataFrame, order: str, key: str, amounts: Sequence[str] | None = None, ages: Sequence[str] | None = None) -> DataFrame:
    """Six weighted signals to a 0-100 score and a letter."""
    numbers = numeric_columns(df)
    amounts = matching(numbers, AMOUNT_NAME) if amounts is None else list(amounts)
    ages = matching(numbers, "age") if ages is None else list(ages)
    lead = numbers[0]
    nulls = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    odd = sum((F.count_if(col(c) < 0) for c in amounts), F.lit(0)) + sum((F.count_if((col(c) > 130) | (col(c) < 0)) for c in ages), F.lit(0))
    s = df.agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls"), odd.alias("odd"), F.avg(col(lead)).alias("m"), F.stddev_pop(col(lead)).alias("sd"))
    s = s.withColumn("dup", duplicate_rows(df).select("extra_rows").scalar()).withColumn("stability", split_half(df, lead, order, key).select("stability").scalar())
    n = F.col("n")
    one = F.lit(1.0)
    cv = F.abs(F.try_divide(F.col("sd"), F.col("m")))
    coverage = F.least(one, n / 200)
    null_score = 1 - F.least(one, _share(F.col("nulls"), n * len(df.columns)) * 4)
    spread = F.when(cv.isNull(), 0.7).when(cv < 2, 1 - F.least(one, cv / 2) * 0.5).otherwise(0.4)
    size = F.when(n >= 100, 1.0).when(n >= 30, 0.7).otherwise(0.35)
    clean = 1 - F.least(one, _share(F.col("odd") + F.col("dup"), n) * 5)
    s = s.withColumns({"coverage": coverage, "null_score": null_score, "spread": spread, "size": size, "clean": clean})
    score = F.round(
        100 * (F.col("coverage") * 0.15 + F.col("null_score") * 0.2 + F.col("spread") * 0.15 + F.coalesce("stability", F.lit(0.7)) * 0.15 + F.col("size") * 0.1 + F.col("clean") * 0.25)
    ).cast("long")
    pct = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    return s.select(
        score.alias("score"), F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D").alias("grade"),
        F.when(score >= 70, "pass").when(score >= 50, "warn").otherwise("fail").alias("status"),
        pct("coverage"), pct("null_score"), pct("spread"), pct("stability"), pct("size"), pct("clean"),
    )


def denial_part(status: str) -> Part:
    def tell(at):
        rate = _share(at("denied"), at("claims"))
        return [F.struct(at("claims").alias("claims"), at("denied").alias("denied"), F.round(rate, 6).alias("rate"), F.when(rate > 0.15, "warn").otherwise("pass").alias("status"))]

    return Part({"claims": F.count(F.lit(1)), "denied": F.count_if(F.lower(col(status).cast("string")).contains("den"))}, tell)


def denial_radar(df: DataFrame, status: str) -> DataFrame:
    return scan(df, denial_part(status))


def schema_fingerprint(df: DataFrame, previous: str | None = None) -> DataFrame:
    """Digest of the sorted (name, type) pairs and whether it changed. The schema is driver metadata."""
    import hashlib
    import json

    digest = hashlib.sha256(json.dumps(sorted([f.name, f.dataType.simpleString()] for f in df.schema.fields)).encode()).hexdigest()
    status = "recorded" if previous is None else "pass" if previous == digest else "fail"
    return df.sparkSession.createDataFrame([(digest, len(df.columns), status)], "digest string, columns int, status string")


def semantic_part(df: DataFrame, ages: Sequence[str] | None = None, percents: Sequence[str] | None = None) -> Part:
    """Ages and percentages out of range as a share of a scan."""
    numbers = numeric_columns(df)
    ages = matching(numbers, "age") if ages is None else list(ages)
    percents = matching(numbers, "rate|percent|pct") if percents is None else list(percents)
    specs = [x for c in ages for x in (("age_over_130", c, col(c) > 130), ("age_negative", c, col(c) < 0))]
    specs += [("percent_over_100", c, col(c) > 100) for c in percents]

    def tell(at):
        bad = lambda v: F.when(v > 0, "fail").otherwise("pass")
        return [finding("semantic_drift", r, [c], bad(at(f"v{i}")), "hard", at(f"v{i}"), F.round(_share(at(f"v{i}"), at("n")), 6)) for i, (r, c, _) in enumerate(specs)]

    return Part({"n": F.count(F.lit(1))} | {f"v{i}": F.count_if(cond) for i, (_, _, cond) in enumerate(specs)}, tell)


def too_many_sexes(column: Column, distinct: Column) -> Column:
    """The finding on the number of a sex column's values; ``column`` may differ by row."""
    row = finding("semantic_drift", "too_many_sexes", [], F.when(distinct > 6, "fail").otherwise("pass"), "hard", distinct, F.lit(0.0))
    return row.withField("columns", F.array(column))


def semantic_drift(df: DataFrame, ages: Sequence[str] | None = None, sexes: Sequence[str] | None = None, percents: Sequence[str] | None = None) -> DataFrame:
    """Values that contradict what a column is called."""
    sexes = matching(df.columns, "gender|sex") if sexes is None else list(sexes)
    part = semantic_part(df, ages, percents)
    s = df.agg(*[c.alias(f"p0_{n}") for n, c in part.wants.items()])
    rows = list(part.tell(lambda n: F.col(f"p0_{n}")))
    for i, c in enumerate(sexes):
        s = s.withColumn(f"d{i}", df.select(col(c)).distinct().agg(F.count(col(c))).scalar())
        rows.append(too_many_sexes(F.lit(c), F.col(f"d{i}")))
    return stack_structs(s, rows)


def compare_with_last(history: DataFrame, run: str, keys: Sequence[str], value: str) -> DataFrame:
    """The last two recorded runs per key, side by side. Only two rows per key are kept."""
    w = Window.partitionBy(*keys).orderBy(F.desc(run))
    r = history.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    pick = lambda k: F.max(F.when(F.col("_r") == k, col(value)))
    return r.groupBy(*keys).agg(pick(2).alias("previous"), pick(1).alias("current"), F.count(F.lit(1)).alias("runs"))


def row_count_drift(history: DataFrame, keys: Sequence[str] = ("table",), run: str = "run_id", value: str = "rows") -> DataFrame:
    c = compare_with_last(history, run, keys, value)
    st = F.when(F.col("runs") < 2, "warn").when(F.col("previous") == F.col("current"), "pass").otherwise("fail")
    return c.withColumn("status", st)


def correlation_part(pairs: Sequence[tuple[str, str]], previous: Mapping[tuple[str, str], float] | None = None) -> Part:
    def tell(at):
        for i, (a, b) in enumerate(pairs):
            old = F.lit((previous or {}).get((a, b))).cast("double")
            r = at(f"r{i}")
            st = F.when(r.isNull() | F.isnan(r), "warn").when(old.isNull(), "pass").when(F.abs(r - old) > 0.3, "fail").otherwise("pass")
            yield F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), r.alias("r"), old.alias("previous"), st.alias("status"))

    return Part({}, tell, Each([{"x": col(a).cast("double"), "y": col(b).cast("double")} for a, b in pairs], {"r": F.corr("x", "y")}))


def correlation_watchdog(df: DataFrame, pairs: Sequence[tuple[str, str]], previous: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """Correlations in one pass and their change from recorded values; a move over 0.3 fails."""
    return scan(df, correlation_part(pairs, previous))


def stated_numbers(texts: DataFrame, key: str, text: str, facts: DataFrame, number: str) -> DataFrame:
    """Numbers written in a text that no fact supports: rows ``(key, stated)``.

    A fact supports its value to 2, 1 or 0 places and, for shares, as a percentage. The
    text numbers and the fact spellings meet in one anti-join on the spelling.
    """
    said = F.regexp_extract_all(col(text), F.lit(r"(-?\d[\d,]*(?:\.\d+)?%?)"), F.lit(1))
    t = texts.select(col(key).alias("key"), F.explode(F.array_distinct(said)).alias("stated"))
    t = t.withColumn("norm", F.regexp_replace(F.regexp_replace("stated", ",", ""), "%", "").try_cast("double"))
    x = col(number).cast("double")
    forms = F.array(F.round(x, 2), F.round(x, 1), F.round(x, 0), F.when(F.abs(x) <= 1, F.round(x * 100, 1)), F.when(F.abs(x) <= 1, F.round(x * 100, 0)))
    ok = facts.select(F.explode(F.array_compact(forms)).alias("norm")).distinct()
    return t.where(F.col("norm").isNotNull()).join(ok, "norm", "left_anti").select("key", "stated")


# Freshness windows in days and the floor trust decays to.
FRESHNESS = {"general": (180, 730, 0.6, "linear"), "healthcare": (90, 365, 0.5, "linear")}


def freshness_badge(age_hours: Column, threshold_hours: float = 24) -> Column:
    return F.when(age_hours > threshold_hours * 3, "fail").when(age_hours > threshold_hours, "warn").otherwise("pass")


def freshness_decay(df: DataFrame, date: str, as_of: Column, pack: str = "general", group_by: Sequence[str] = (), shape: str | None = None) -> DataFrame:
    """Age of the newest row and the trust multiplier that follows from it.

    Between stale and expired trust falls in the pack's ``shape`` or the one given: linear or exponential.
    """
    stale, expired, floor, usual = FRESHNESS[pack]
    shape = shape or usual
    if shape not in ("linear", "exponential"):
        raise ValueError(f"no decay of shape {shape}")
    s = df.groupBy(*[col(g) for g in group_by]).agg(F.max(col(date)).cast("timestamp").alias("newest"))
    return s.select(*[col(g) for g in group_by], *_decayed(F.col("newest"), as_of, stale, expired, floor, shape))


def freshness_part(date: str, as_of: Column, pack: str) -> Part:
    stale, expired, floor, shape = FRESHNESS[pack]
    return Part({"newest": F.max(col(date)).cast("timestamp")}, lambda at: [F.struct(*_decayed(at("newest"), as_of, stale, expired, floor, shape))])


def _decayed(newest: Column, as_of: Column, stale: int, expired: int, floor: float, shape: str) -> list[Column]:
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(newest)) / 86400.0)
    progress = (age - stale) / (expired - stale)
    slope = floor + (1 - floor) * F.exp(-3 * progress) if shape == "exponential" else 1 - (1 - floor) * progress
    mult = F.when(newest.isNull() | (age <= stale), 1.0).when(age >= expired, floor).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(floor), slope)))
    st = F.when(newest.isNull(), "unknown").when(age <= stale, "fresh").when(age >= expired, "expired").otherwise("stale")
    return [F.round(age, 1).alias("age_days"), F.round(mult, 6).alias("multiplier"), st.alias("status")]


def table_digest(df: DataFrame) -> Column:
    """Order-free digest: sums of two row hashes, exact in decimals."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *[col(c) for c in df.columns]).cast("decimal(38,0)"))
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), h(1).cast("string"), h(2).cast("string"))


def reproducibility(df: DataFrame, runs: int = 3) -> DataFrame:
    """The same digest from independent runs over differently partitioned rows.

    The numbers of partitions grow with those of the table, so no task reads a fixed share of it.
    """
    out, most = None, max(tasks(df), df.rdd.getNumPartitions())
    for i in range(runs):
        one = (df if i == 0 else df.repartition(most + 2 * i + 1)).agg(table_digest(df).alias("digest"))
        out = one if out is None else out.unionByName(one)
    s = out.agg(F.count_distinct("digest").alias("distinct_digests"), F.count(F.lit(1)).alias("runs"))
    return s.withColumn("status", F.when(F.col("distinct_digests") == 1, "pass").otherwise("fail"))


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Modified z over 3.5 and Tukey fences, both sides, per numeric column, from exact quantiles."""
    q, known, mad = _fences(df, list(columns) if columns is not None else numeric_columns(df))
    return scan(df, _fences_part(known, q, mad))


def outliers_part(df: DataFrame, columns: Sequence[str]) -> Part:
    """The counts beyond fences as a share of a scan; the quantiles that set the fences are found now."""
    q, known, mad = _fences(df, columns)
    return _fences_part(known, q, mad)


def _fences(df: DataFrame, cols: Sequence[str]) -> tuple[dict, list[str], dict]:
    q = quantile_map(df, cols, [0.25, 0.5, 0.75])
    known = [c for c in cols if q.get((c, 0.5)) is not None]
    dev = df.select(*[F.abs(col(c).cast("double") - F.lit(q[c, 0.5])).alias(c) for c in known])
    return q, known, quantile_map(dev, known, [0.5])


def _fences_part(known: Sequence[str], q: Mapping, mad: Mapping) -> Part:
    wants = {}
    for i, c in enumerate(known):
        q1, med, q3, m = q[c, 0.25], q[c, 0.5], q[c, 0.75], mad[c, 0.5]
        x, iqr = col(c).cast("double"), q3 - q1
        far = F.abs(0.6745 * (x - med) / m) > 3.5 if m and m > 0 else F.lit(False)
        wants |= {
            f"a{i}": F.count_if(x < q1 - 1.5 * iqr), f"b{i}": F.count_if(x > q3 + 1.5 * iqr),
            f"c{i}": F.count_if(far & (x < med)), f"d{i}": F.count_if(far & (x > med)),
        }

    def tell(at):
        for i, c in enumerate(known):
            yield F.struct(
                F.lit(c).alias("column"), F.lit(q[c, 0.5]).alias("median"), F.lit(mad[c, 0.5]).alias("mad"), F.lit(q[c, 0.25]).alias("q1"), F.lit(q[c, 0.75]).alias("q3"),
                at(f"a{i}").alias("iqr_low"), at(f"b{i}").alias("iqr_high"), at(f"c{i}").alias("mad_low"), at(f"d{i}").alias("mad_high"),
            )

    return Part(wants, tell)


# Expected leading-digit shares, and names that rule the test out or in.
BENFORD = (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046)
BENFORD_BOUNDED = {
    "age", "rating", "score", "star", "stars", "grade", "level", "rank", "year", "quarter", "month", "week", "day", "hour",
    "minute", "percent", "pct", "rate", "ratio", "likert",
}
BENFORD_MAGNITUDE = r"amount|revenue|sales|price|cost|charge|population|transaction|balance|income|expense|salary|payment|volume|total|value|spend|budget"


def benford(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Leading-digit test with its eligibility gate, all columns in one pass."""
    return scan(df, benford_part(list(columns) if columns is not None else numeric_columns(df)))


def _orders_seen(order: Column) -> Column:
    """How many orders of magnitude (0 to 308, 319 for infinity) occur, as bits of five numbers: fixed buffers, no set."""
    masks = [F.bit_or(F.when((order >= 64 * k) & (order < 64 * k + 64), F.call_function("shiftleft", F.lit(1).cast("long"), order - 64 * k))) for k in range(5)]
    return sum((F.coalesce(F.bit_count(m), F.lit(0)) for m in masks), F.lit(0))


def benford_part(cols: Sequence[str]) -> Part:
    x, order, d = F.col("x"), F.col("o"), F.col("d")
    big = x >= 1
    # the digit is a column of its own, so it is worked out once per value and not once per count
    derived = {"d": F.when(big, leading_digit(x)), "o": F.when(big, F.least(F.floor(F.log10(x)), F.lit(319)).cast("int"))}
    wants = {"n": F.count_if(big), "nn": F.count(x), "nb": F.count_if((x != 0) & (x != 1)), "o": _orders_seen(order)}
    wants |= {f"d{k}_": F.count_if(d == k) for k in range(1, 10)}
    each = Each([{"x": F.abs(col(c).cast("double"))} for c in cols], wants, derived, dict.fromkeys(wants, 0))

    def tell(at):
        for i, c in enumerate(cols):
            n = at(f"n{i}")
            off = lambda k: at(f"d{k}_{i}") - BENFORD[k - 1] * n  # noqa: E731, B023
            chi = sum((F.try_divide(off(k) * off(k), BENFORD[k - 1] * n) for k in range(1, 10)), F.lit(0.0))
            gate = (
                F.when(F.lit(bool(BENFORD_BOUNDED & set(name_tokens(c)))), "bounded_name")
                .when((at(f"nn{i}") > 0) & (at(f"nb{i}") == 0), "binary_flag")
                .when(n < 50, "small_sample")
                .when((at(f"o{i}") < 2) & F.lit(not re.search(BENFORD_MAGNITUDE, c, re.I)), "narrow_range")
            )
            yield F.struct(
                F.lit(c).alias("column"), n.alias("n"), gate.alias("skipped"), F.when(gate.isNull(), F.round(chi, 4)).alias("chi_square"),
                F.when(gate.isNotNull(), "idle").when(chi > 15.51, "warn").otherwise("pass").alias("status"),
            )

    return Part({}, tell, each)


# ---- missingness, bias, equity ------------------------------------------------------

# Name stems of fields that are normally recorded.
CORE_STEMS = (
    "id", "age", "sex", "gender", "dob", "birth", "date", "outcome", "result", "diagnosis", "status", "income", "salary", "weight",
    "height", "score", "label", "target", "response", "total", "amount", "price", "value",
)


def _missing_by_group(df: DataFrame, targets: Sequence[str], drivers: Sequence[str]) -> DataFrame:
    """Rows ``(driver, grp, column, n, missing)``: one pass counts all targets in all driver groups."""
    pairs = F.array(*[F.struct(F.lit(d).alias("driver"), col(d).cast("string").alias("grp")) for d in drivers])
    g = df.select(F.explode(pairs).alias("p"), *[col(t).isNull().cast("long").alias(f"_m{i}") for i, t in enumerate(targets)])
    g = g.where(F.col("p.grp").isNotNull()).groupBy("p.driver", "p.grp").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(targets))])
    cells = F.array(*[F.struct(F.lit(t).alias("column"), F.col(f"_m{i}").alias("missing")) for i, t in enumerate(targets)])
    return g.select("driver", "grp", "n", F.explode(cells).alias("c")).select("driver", "grp", "n", "c.*").where(F.col("driver") != F.col("column"))


def missing_part(targets: Sequence[str]) -> Part:
    return Part({"n": F.count(F.lit(1))} | {f"m{i}": F.count_if(col(t).isNull()) for i, t in enumerate(targets)}, lambda at: [])


MIN_MISSING = 0.03


def missingness_drivers(
    df: DataFrame, targets: Sequence[str] | None = None, min_rate: float = MIN_MISSING, min_group: int = 20, diff: float = 0.15, ratio: float = 2.0, separation: float = 0.5,
    missing: tuple[int, Mapping[str, int]] | None = None, by_group: DataFrame | None = None,
) -> DataFrame:
    """For each column with missing values: the observed column that best explains it (MAR), or none (MCAR).

    ``missing`` (rows, missing values of each target) and ``by_group`` (see ``_missing_by_group``) may
    come from scans that were made already.
    """
    targets = list(targets) if targets is not None else df.columns
    if missing is None:
        row = df.agg(*[c.alias(k) for k, c in missing_part(targets).wants.items()]).first()
        missing = row["n"], {t: row[f"m{i}"] for i, t in enumerate(targets)}
    n, gaps = missing
    picked = {t: gaps[t] for t in targets if n and min_rate <= gaps[t] / n < 1}
    schema = "column string, missing_count bigint, missing_rate double, classification string, driver string, effect double, mnar_caution boolean"
    spark = df.sparkSession
    if not picked:
        return spark.createDataFrame([], schema)
    cats = [c for c in df.columns if kind_of(df.schema[c].dataType) in ("text", "boolean")]
    drivers = cats  # every one: groups below min_group drop out, however many values there are
    effects = None
    if drivers:
        found = by_group if by_group is not None else _missing_by_group(df, list(picked), drivers)
        g = found.where(F.col("n") >= min_group).withColumn("rate", F.col("missing") / F.col("n"))
        s = g.groupBy("column", "driver").agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"), F.count(F.lit(1)).alias("groups")).where("groups >= 2")
        d = F.col("hi") - F.col("lo")
        effects = s.where((d >= diff) | (F.col("hi") / F.greatest(F.col("lo"), F.lit(0.02)) >= ratio)).select("column", "driver", d.alias("effect"))
    numbers = numeric_columns(df)
    combos = [(t, c) for t in picked for c in numbers if t != c]
    if combos:
        aggs, rows = [], []
        for i, (t, c) in enumerate(combos):
            miss, x = col(t).isNull(), col(c).cast("double")
            for tag, cond in (("m", miss), ("p", ~miss)):
                v = F.when(cond, x)
                aggs += [F.count(v).alias(f"{tag}n{i}"), F.avg(v).alias(f"{tag}a{i}"), F.stddev_samp(v).alias(f"{tag}s{i}")]
            mn, pn = F.col(f"mn{i}"), F.col(f"pn{i}")
            ms, ps = F.coalesce(F.col(f"ms{i}"), F.lit(0.0)), F.coalesce(F.col(f"ps{i}"), F.lit(0.0))
            pooled = F.sqrt(((mn - 1) * ms * ms + (pn - 1) * ps * ps) / F.greatest(mn + pn - 2, F.lit(1)))
            sep = F.try_divide(F.abs(F.col(f"ma{i}") - F.col(f"pa{i}")), pooled)
            rows.append(F.when((mn >= min_group) & (pn >= min_group) & (sep >= separation), F.struct(F.lit(t).alias("column"), F.lit(c).alias("driver"), sep.alias("effect"))))
        num = df.agg(*aggs).select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")
        effects = num if effects is None else effects.unionByName(num)
    base = spark.createDataFrame(
        [(t, m, m / n, bool(m / n >= 0.3 and any(w == s or w.startswith(s) for w in name_tokens(t) for s in CORE_STEMS))) for t, m in picked.items()],
        "column string, missing_count bigint, missing_rate double, mnar_caution boolean",
    )
    if effects is None:
        effects = spark.createDataFrame([], "column string, driver string, effect double")
    best = effects.groupBy("column").agg(F.min_by(F.struct("driver", "effect"), F.struct(-F.col("effect"), F.col("driver"))).alias("b"))
    return base.join(F.broadcast(best), "column", "left").select(
        "column", "missing_count", F.round("missing_rate", 6).alias("missing_rate"), F.when(F.col("b").isNull(), "MCAR").otherwise("MAR").alias("classification"),
        F.col("b.driver").alias("driver"), F.round("b.effect", 3).alias("effect"), "mnar_caution",
    )


def missingness_ratio(df: DataFrame, targets: Sequence[str], factor: float = 2.0, min_group: int = 5) -> DataFrame:
    """Strongest ratio between the highest and lowest missing rate over the groups of another column, groups of ``min_group`` rows on."""
    cats = [c for c in df.columns if kind_of(df.schema[c].dataType) == "text"]
    g = _missing_by_group(df, targets, cats).where(F.col("n") >= min_group).withColumn("rate", F.col("missing") / F.col("n"))
    s = g.groupBy("column", "driver").agg(F.max("rate").alias("high"), F.min("rate").alias("low"), F.count(F.lit(1)).alias("groups")).where("groups >= 2")
    s = s.withColumn("ratio", F.col("high") / F.greatest(F.col("low"), F.lit(0.01)))
    best = s.where(F.col("ratio") >= factor).groupBy("column").agg(F.min_by(F.struct("driver", "high", "low", "ratio"), F.struct(-F.col("ratio"), F.col("driver"))).alias("b"))
    rounded = lambda f: F.round(F.col(f"b.{f}"), 6).alias(f)
    return best.select("column", F.col("b.driver").alias("driver"), rounded("high"), rounded("low"), rounded("ratio"))


# Words that mark a demographic column.
DEMOGRAPHIC = (
    "race", "gender", "sex", "age", "ethnicity", "nationality", "religion", "disability", "income", "education", "zip", "zipcode",
    "postal", "region", "county", "state", "country", "language", "marital", "veteran", "citizen", "birth", "dob",
)


def bias_preflight(df: DataFrame, demographic: Sequence[str] | None = None) -> DataFrame:
    """Imbalance, clustered nulls, skew and null burden: rows ``(kind, column, severity, value, deduction)``."""
    demo = list(demographic) if demographic is not None else [c for c in df.columns if any(w in c.lower() for w in DEMOGRAPHIC)]
    texts, numbers = text_columns(df), numeric_columns(df)
    from plumbline.plans.profile import value_counts

    none = "kind string, column string, severity string, value double, deduction int"
    parts = [df.sparkSession.createDataFrame([], none)]
    out = lambda d, kind, c, high, v, hi, lo: d.select(
        F.lit(kind).alias("kind"), c.alias("column"), F.when(high, "high").otherwise("moderate").alias("severity"), F.round(v, 6).alias("value"), F.when(high, hi).otherwise(lo).alias("deduction")
    )
    if texts:
        v = value_counts(df, texts, True).groupBy("column").agg(F.sum("n").alias("nn"), F.max("n").alias("top"), F.count(F.lit(1)).alias("d"))
        share = F.col("top") / F.col("nn")
        parts.append(out(v.where((F.col("nn") >= 5) & (F.col("d") >= 2) & (share >= 0.7)), "class_imbalance", F.col("column"), share >= 0.9, share, 20, 10))
    blank = lambda c: col(c).isNull() if c not in texts else col(c).isNull() | (F.trim(col(c)) == "")
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(blank(c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    n, miss = row["n"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}
    gappy = [c for c, m in miss.items() if n and m / n >= 0.25]
    spark = df.sparkSession
    if gappy and demo:
        clean = df.select(*[F.when(~blank(c), col(c)).alias(c) for c in df.columns])
        rates = spark.createDataFrame([(c, miss[c] / n) for c in gappy], "column string, overall double")
        g = _missing_by_group(clean, gappy, demo).where("n >= 5").withColumn("rate", F.col("missing") / F.col("n"))
        w = g.groupBy("column", "driver").agg(F.max("rate").alias("worst")).join(F.broadcast(rates), "column")
        parts.append(out(w.where(F.col("worst") > F.col("overall") * 1.4), "missing_cluster", F.concat_ws(" by ", "column", "driver"), F.col("worst") > 0.5, F.col("worst"), 18, 8))
    if numbers:
        q = quantile_map(df, numbers, [0.5])
        s = df.agg(*[x for i, c in enumerate(numbers) for x in (F.count(col(c)).alias(f"n{i}"), F.avg(col(c)).alias(f"a{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nn"), F.try_divide(F.col(f"a{i}") - F.lit(q.get((c, 0.5))).cast("double"), F.col(f"s{i}")).alias("sk")) for i, c in enumerate(numbers)]
        k = stack_structs(s, rows).where((F.col("nn") >= 20) & (F.abs("sk") > 1.0))
        parts.append(out(k, "distribution_skew", F.col("column"), F.abs("sk") > 2.0, F.col("sk"), 12, 6))
    burden = sum(miss.values()) / (n * len(df.columns)) if n else 0.0
    if burden > 0.15:
        parts.append(spark.createDataFrame([("null_burden", "*", "high" if burden > 0.3 else "moderate", round(burden, 6), 15 if burden > 0.3 else 8)], none))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def bias_score(findings: DataFrame) -> DataFrame:
    s = findings.agg(F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum("deduction"), F.lit(0))).alias("score"), F.count(F.lit(1)).alias("findings"))
    sc = F.col("score")
    return s.withColumn("grade", F.when(sc >= 80, "CLEAN").when(sc >= 60, "REVIEW").when(sc >= 40, "CAUTION").otherwise("CONCERN"))


# Column-name words per equity dimension.
EQUITY_NAMES = {"race": r"race|ethnic", "sex": r"gender|\bsex\b|^sex|_sex", "geography": r"zip|postal|region|county|state", "payer": r"payer|payor|insur|plan", "language": r"language|lang$"}


def equity_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    return {k: matching(columns, rx) for k, rx in EQUITY_NAMES.items() if matching(columns, rx)}


def stratify(df: DataFrame, stratifier: str, metric: Column) -> DataFrame:
    """Group size and mean of a metric per stratum, over all rows."""
    return df.where(col(stratifier).isNotNull()).groupBy(col(stratifier).cast("string").alias("group")).agg(F.count(metric).alias("n"), F.avg(metric.cast("double")).alias("value"))


def disparity(groups: DataFrame, binary: bool = True, reference: str = "population_mean", min_cell: int = 5) -> DataFrame:
    """Score each stratum against the reference: rate ratio and difference, or relative deviation."""
    g = groups.where((F.col("n") >= min_cell) & F.col("value").isNotNull())
    if reference == "largest_group":
        ref = g.agg(F.max_by("value", F.struct("n", "group"))).scalar()
    else:
        ref = g.agg(F.sum(F.col("value") * F.col("n")) / F.sum("n")).scalar()
    return g.select("group", "n", *_judged(F.col("value"), ref, F.lit(binary)))


def _judged(v: Column, ref: Column, binary: Column) -> list[Column]:
    d = v - ref
    ratio = F.when(ref > 0, v / ref).when(v > 0, F.lit(99.0)).otherwise(1.0)
    size = F.greatest(ratio, F.when(ratio > 0, 1 / ratio).otherwise(1.0))
    off = F.try_divide(F.abs(d), F.abs(ref))
    kind = lambda yes, no: F.when(binary, yes).otherwise(no)
    fail = kind((size >= 1.5) | (F.abs(d) >= 0.05), off >= 0.2)
    warn = kind((size >= 1.25) | (F.abs(d) >= 0.03), off >= 0.1)
    high = kind((size >= 2) | (F.abs(d) >= 0.10), off >= 0.4)
    st = F.when(fail, "fail").when(warn, "warn").otherwise("pass")
    level = F.when(fail & high, "high").when(fail, "medium").when(warn, "low").otherwise("none")
    return [F.round(v, 6).alias("value"), F.round(ref, 6).alias("reference"), F.round(kind(ratio, off), 6).alias("measure"), F.round(d, 6).alias("difference"), st.alias("status"), level.alias("level")]


def disparities(groups: DataFrame, min_cell: int = 5) -> DataFrame:
    """``disparity`` of every (stratifier, metric) of ``groups`` (with group, n, value, binary) against its mean over all groups."""
    g = groups.where((F.col("n") >= min_cell) & F.col("value").isNotNull())
    means = g.groupBy("stratifier", "metric").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("ref"))
    return g.join(means, ["stratifier", "metric"]).select("stratifier", "metric", "group", "n", *_judged(F.col("value"), F.col("ref"), F.col("binary")))


# ---- claims -------------------------------------------------------------------------


def claim_root_causes(df: DataFrame, claim: str, member: str, service_date: str, cpt: str, dx: str, npi: str, secondary_payer: str | None = None, coverage_start: str | None = None, coverage_end: str | None = None, tolerance_days: int = 1) -> DataFrame:
    """One row per claim line with the five denial-risk flags.

    Exact repeats are every line but the first of (member, date, code); near repeats are
    lines whose (member, code) also occurs on an earlier day within the tolerance.
    """
    blank = lambda c: col(c).isNull() | (F.trim(col(c).cast("string")) == "")
    dos = col(service_date).try_cast("date") if kind_of(df.schema[service_date].dataType) == "text" else col(service_date).cast("date")
    elig = blank(member)
    if coverage_start:
        elig = elig | F.coalesce(dos < col(coverage_start).cast("date"), F.lit(False))
    if coverage_end:
        elig = elig | F.coalesce(dos > col(coverage_end).cast("date"), F.lit(False))
    coding = blank(cpt) | ~cpt_shaped(col(cpt)) | blank(dx) | ~icd10_shaped(col(dx))
    provider = blank(npi) | ~npi_valid(F.trim(col(npi).cast("string")))
    cob = ~blank(secondary_payer) if secondary_payer else F.lit(False)
    d = df.withColumns({"_dos": dos, "eligibility": elig, "coding": coding, "provider": provider, "cob": cob})
    usable = ~blank(member) & ~blank(cpt)
    days = d.where(usable).groupBy(col(member).alias("_m"), col(cpt).alias("_c"), "_dos").agg(F.min(col(claim)).alias("_first"), F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy("_m", "_c").orderBy("_dos")
    days = days.withColumn("_gap", F.datediff("_dos", F.lag("_dos").over(w))).withColumnRenamed("_dos", "_d")
    j = d.join(days, (col(member) == F.col("_m")) & (col(cpt) == F.col("_c")) & F.col("_dos").eqNullSafe(F.col("_d")), "left")
    exact = (F.col("_k") > 1) & (col(claim) != F.col("_first"))
    near = F.col("_gap").between(1, tolerance_days)
    dup = F.coalesce(exact | near, F.lit(False))
    return j.select(*[col(c) for c in df.columns], "eligibility", "coding", dup.alias("duplicate"), "provider", "cob")


CAUSES = ("eligibility", "coding", "duplicate", "provider", "cob")


def claim_report(flags: DataFrame, per_error_cost: float = 118.0) -> DataFrame:
    """Lines per cause, share, and the estimated rework cost of the flagged lines."""
    any_flag = F.lit(False)
    for c in CAUSES:
        any_flag = any_flag | F.col(c)
    s = flags.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_flag).alias("any"), *[F.count_if(F.col(c)).alias(c) for c in CAUSES])
    row = lambda name, v: F.struct(F.lit(name).alias("cause"), v.alias("lines"), F.round(_share(v, F.col("n")) * 100, 1).alias("pct"), (v * per_error_cost).alias("cost"))
    return stack_structs(s, [row(c, F.col(c)) for c in CAUSES] + [row("any", F.col("any"))])


# ---- findings to verdicts -----------------------------------------------------------

RANK = {"idle": 0, "pass": 1, "warn": 2, "fail": 3}


def layer_status(findings: DataFrame) -> DataFrame:
    """Worst status per layer."""
    rank = F.lit(0)
    for s, v in RANK.items():
        rank = F.when(F.col("status") == s, v).otherwise(rank)
    back = F.when(F.col("_r") == 3, "fail").when(F.col("_r") == 2, "warn").when(F.col("_r") == 1, "pass").otherwise("idle")
    soft = F.max("reinterpreted") if "reinterpreted" in findings.columns else F.lit(False)
    g = findings.groupBy("layer").agg(F.max(rank).alias("_r"), F.count(F.lit(1)).alias("findings"), soft.alias("reinterpreted"))
    return g.select("layer", back.alias("status"), "findings", "reinterpreted")


# Weights of the two grading axes.
INTEGRITY_WEIGHTS = {"unit_tests": 0.30, "cross_column": 0.25, "categorical": 0.15, "schema": 0.12, "two_paths": 0.10, "reproducibility": 0.08}
DOMAIN_WEIGHTS = {"vitals": 0.30, "drift": 0.25, "semantic_drift": 0.15, "outliers": 0.12, "benford": 0.10, "correlation": 0.08}


def _letter(x: Column) -> Column:
    return F.when(x >= 0.9, "A").when(x >= 0.8, "B").when(x >= 0.7, "C").when(x >= 0.6, "D").otherwise("F")


def calibrated_grades(findings: DataFrame) -> DataFrame:
    """Integrity, plausibility and overall grade. A reinterpreted concern earns at least 0.9 on its layer."""
    s = layer_status(findings)
    base = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).when(F.col("status") == "fail", 0.0)

    def weight(table):
        w = F.lit(None).cast("double")
        for k, v in table.items():
            w = F.when(F.col("layer") == k, v).otherwise(w)
        return w

    s = s.withColumns({"base": base, "wi": weight(INTEGRITY_WEIGHTS), "wd": weight(DOMAIN_WEIGHTS)}).where(F.col("base").isNotNull())
    credited = F.when(F.col("reinterpreted"), F.greatest(F.col("base"), F.lit(0.9))).otherwise(F.col("base"))
    mean = lambda v, w: F.coalesce(F.try_divide(F.sum(v * F.col(w)), F.sum(F.when(v.isNotNull(), F.col(w)))), F.lit(1.0))
    t = s.agg(mean(F.col("base"), "wi").alias("integrity"), mean(credited, "wd").alias("plausibility"))
    t = t.withColumn("overall", (F.col("integrity") + F.col("plausibility")) / 2)
    rows = [F.struct(F.lit(a).alias("axis"), F.round(F.col(a), 3).alias("score"), _letter(F.col(a)).alias("grade")) for a in ("integrity", "plausibility", "overall")]
    return stack_structs(t, rows)


def cat_scorecard(df: DataFrame, findings: DataFrame, age_hours: Column) -> DataFrame:
    """Completeness, accuracy, timeliness and their mean, each with a letter."""
    nulls = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    complete = df.agg(1 - _share(nulls, F.count(F.lit(1)) * len(df.columns))).scalar()
    st = layer_status(findings).where(F.col("layer").isin("unit_tests", "semantic_drift", "outliers") & (F.col("status") != "idle"))
    s = st.agg(F.coalesce(F.avg((F.col("status") == "pass").cast("double")), F.lit(0.8)).alias("accuracy"))
    timely = F.when(age_hours <= 24, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (age_hours - 24) / (24 * 7.0)))
    s = s.withColumns({"completeness": complete, "timeliness": timely})
    s = s.withColumn("overall", (F.col("completeness") + F.col("accuracy") + F.col("timeliness")) / 3)
    rows = [F.struct(F.lit(a).alias("axis"), F.round(F.col(a), 3).alias("score"), _letter(F.col(a)).alias("grade")) for a in ("completeness", "accuracy", "timeliness", "overall")]
    return stack_structs(s, rows)


def readiness_verdict(findings: DataFrame, threshold: int = 70, contract_broken: bool = False) -> DataFrame:
    """May the data be consumed: mean layer weight x 100 at or over the threshold and no hard fail."""
    s = layer_status(findings).where("status <> 'idle'")
    w = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    t = s.agg(F.coalesce(F.round(F.avg(w) * 100), F.lit(0.0)).cast("long").alias("score"), F.count_if(F.col("status") == "fail").alias("failing_layers"), F.count(F.lit(1)).alias("layers"))
    ok = F.lit(not contract_broken) & (F.col("failing_layers") == 0) & (F.col("layers") > 0) & (F.col("score") >= threshold)
    return t.withColumn("consumable", ok)


# What a domain pack reinterprets. (kind, column pattern, binary columns only)
PACKS: dict[str, list[tuple[str, str, bool]]] = {
    "healthcare": [
        ("deid-date-shift", r"date|admit|discharge|dob|birth|time|_dt$|_at$", False),
        ("no-merge", r"race|ethnic|insurance|payer|payor|gender|\bsex\b|religion|marital", False),
        ("benford-exempt", r".*", True),
    ],
    "retail": [
        ("no-merge", r"(^|[_\s-])sku([_\s-]|$)|product[_\s-]?code|item[_\s-]?(code|no|number)|\bupc\b|barcode|\basin\b", False),
        ("benford-exempt", r"return|refund|is[_\s-]?returned|chargeback", True),
        ("outlier-context", r"price|sales|revenue|gmv|units[_\s-]?sold|qty|quantity|discount|margin", False),
    ],
    "finance": [
        ("no-merge", r"ledger|(^|[_\s-])account([_\s-]|$)|\bacct\b|gl[_\s-]?(code|account|no)|chart[_\s-]?of[_\s-]?accounts|cost[_\s-]?cent(er|re)", False),
        ("benford-exempt", r"reconcil|posted|cleared|void|is[_\s-]?paid|settled", True),
        ("outlier-context", r"debit|credit|(^|[_\s-])amount([_\s-]|$)|balance|journal|(^|[_\s-])entry([_\s-]|$)|posting", False),
    ],
    "none": [],
}
_PACK_TARGET = {"no-merge": "categorical", "benford-exempt": "benford", "outlier-context": "outliers", "deid-date-shift": "unit_tests"}


def apply_pack(findings: DataFrame, pack: str | Sequence[tuple[str, str, bool]] = "healthcare", binary_columns: Sequence[str] = ()) -> DataFrame:
    """Reinterpret findings under a domain pack (built in, or a list of ``(kind, pattern, binary_only)``).

    De-identified date shifts soften to warn, exempt columns leave the digit test idle,
    expected swings pass, protected categories lose their merge offer. Adds ``reinterpreted``.
    """
    rules = PACKS[pack] if isinstance(pack, str) else list(pack)
    status, hit = F.col("status"), F.lit(False)
    concern = F.col("status").isin("warn", "fail")
    for kind, pattern, binary in rules:
        named = F.exists("columns", lambda c: c.rlike("(?i)" + pattern))
        if binary:
            named = named & F.exists("columns", lambda c: c.isin(*binary_columns) if binary_columns else F.lit(False))
        match = (F.col("layer") == _PACK_TARGET[kind]) & named & concern
        if kind == "deid-date-shift":
            match = match & (F.col("rule") == "future_date") & (F.col("detail").try_cast("double") > 0.9)
            status = F.when(match, "warn").otherwise(status)
        elif kind == "benford-exempt":
            status = F.when(match, "idle").otherwise(status)
        elif kind == "outlier-context":
            status = F.when(match, "pass").otherwise(status)
        hit = hit | F.coalesce(match, F.lit(False))
    return findings.withColumns({"status": status, "reinterpreted": hit})


def outlier_concentration(df: DataFrame, value: str, categories: Sequence[str], z: float = 2.5, share: float = 0.5) -> DataFrame:
    """Categories in which at least half of a column's outlier rows sit."""
    s = df.agg(F.struct(F.avg(col(value)).alias("m"), F.stddev_pop(col(value)).alias("sd"))).scalar()
    out = F.abs(F.try_divide(col(value) - s["m"], s["sd"])) > z
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(col(c).cast("string"), F.lit("null")).alias("group")) for c in categories])
    d = df.select(F.coalesce(out, F.lit(False)).alias("o"), pairs.alias("p"))
    total = d.agg(F.count_if("o")).scalar()
    g = d.select("o", F.explode("p").alias("x")).groupBy("x.category", "x.group").agg(F.count_if("o").alias("outliers"), F.count(F.lit(1)).alias("rows"))
    frac = F.try_divide(F.col("outliers").cast("double"), total)
    return g.select("category", "group", "outliers", "rows", F.round(frac, 6).alias("share")).where(F.col("share") >= share)


def column_health(row_findings: DataFrame) -> DataFrame:
    """Per column: distinct rows per severity and ``1 - .1 warnings - .2 errors - .3 criticals``."""
    d = row_findings.select("row_id", "column", "severity").distinct()
    n = lambda s: F.count_if(F.col("severity") == s)
    g = d.groupBy("column").agg(n("warning").alias("warnings"), n("error").alias("errors"), n("critical").alias("criticals"))
    score = F.greatest(F.lit(0.0), 1 - F.col("warnings") * 0.1 - F.col("errors") * 0.2 - F.col("criticals") * 0.3)
    return g.withColumn("score", F.round(score, 3))


def row_severity(row_findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    g = row_findings.groupBy("row_id").agg(F.max(rank).alias("r"))
    return g.select("row_id", F.when(F.col("r") == 3, "critical").when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("info").alias("severity"))


def layer_priority(feedback: DataFrame, decay: float = 0.97, order: str = "at", key: str = "id") -> DataFrame:
    """Layers ranked by the decayed share of accepted findings: ``(accepts + 1) / (actions + 2)``.

    Older actions of a layer count ``decay`` to the power of the actions after them.
    """
    totals = feedback.groupBy(F.col("layer").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    p = with_order(feedback, order, key, partition=["layer"]).join(totals, F.col("layer") == F.col("_l"))
    weight = F.pow(F.lit(decay), (F.col("_n") - F.col("_pos")).cast("double"))
    g = p.groupBy("layer").agg(
        F.count(F.lit(1)).alias("actions"), F.sum(F.when(F.col("accepted"), weight).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("accepted"), weight).otherwise(0.0)).alias("d")
    )
    score = (F.col("a") + 1) / (F.col("a") + F.col("d") + 2)
    tier = F.when(score >= 0.6, "promote").when(score <= 0.4, "sink").otherwise("neutral")
    return g.select("layer", "actions", F.round(score, 6).alias("score"), tier.alias("tier"))


def traffic_lights(df: DataFrame) -> DataFrame:
    """Red over 20 % empty, amber over 5 % or any negative, else green."""
    numbers = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        empty = col(c).isNull() if kind_of(df.schema[c].dataType) != "text" else col(c).isNull() | (col(c) == "")
        aggs += [F.count_if(empty).alias(f"e{i}"), (F.count_if(col(c) < 0) if c in numbers else F.lit(0).cast("long")).alias(f"g{i}")]
    rows = []
    for i, c in enumerate(df.columns):
        rate = _share(F.col(f"e{i}"), F.col("n"))
        light = F.when(rate > 0.2, "red").when((rate > 0.05) | (F.col(f"g{i}") > 0), "amber").otherwise("green")
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"e{i}").alias("empty"), F.col(f"g{i}").alias("negatives"), F.round(rate, 6).alias("empty_rate"), light.alias("light")))
    return stack_structs(df.agg(*aggs), rows)


def row_lights(df: DataFrame, key: str, lights: Mapping[str, str]) -> DataFrame:
    """Rows flagged by the columns that are red (empty cell) or amber (empty or negative cell)."""
    numbers = set(numeric_columns(df))
    err, warn = F.lit(False), F.lit(False)
    for c, light in lights.items():
        if light == "green":
            continue
        empty = col(c).isNull() if kind_of(df.schema[c].dataType) != "text" else col(c).isNull() | (col(c) == "")
        if light == "red":
            err = err | empty
        else:
            warn = warn | empty
        if c in numbers:
            warn = warn | F.coalesce(col(c) < 0, F.lit(False))
    return df.select(col(key), err.alias("error"), warn.alias("warning")).where("error or warning")


def age_consistency(encounters: DataFrame, patients: DataFrame, tolerance_years: float = 1.0) -> DataFrame:
    """Encounters whose recorded age disagrees with the patient's birth date."""
    p = patients.select(F.col("id").alias("_pid"), F.col("birth_date").cast("date").alias("_born"))
    e = encounters.where(F.col("age").isNotNull()).join(p, F.col("patient") == F.col("_pid"))
    actual = F.floor(F.months_between(F.col("start").cast("date"), F.col("_born")) / 12)
    return e.withColumn("actual_age", actual.cast("long")).where(F.abs(F.col("age") - F.col("actual_age")) > tolerance_years).select("id", "patient", "age", "actual_age")


def near_duplicate_claims(df: DataFrame, member: str, cpt: str, service_date: str, tolerance_days: int = 1) -> DataFrame:
    return near_duplicates(df, [member, cpt], service_date, tolerance_days)
