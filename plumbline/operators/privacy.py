"""Identifier scan, k-anonymity, noised aggregates, synthetic rows, shareable fingerprints."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import scalar_row
from plumbline.model import col, kind_of, stack_structs
from plumbline.session import cut_lineage

GRID = (-64, 64)  # powers of two among which a bound of values is sought

# The eighteen identifier categories, by column name and by value shape.
IDENTIFIERS: list[tuple[str, str, str | None]] = [
    ("names", r"(^|_)(name|surname|first_?name|last_?name|full_?name|middle_?name|maiden|given|patient|provider_name)($|_)", None),
    ("geo", r"(^|_)(address|street|city|county|precinct|zip|zipcode|postal|postcode|geo|location|region|district|neighbou?rhood)($|_)", r"^\d{5}(-\d{4})?$"),
    ("dates", r"(^|_)(dob|birth|birth_?date|date_of_birth|admission|admit|discharge|death|deceased|expire|dod|date|_dt|visit_date|service_date|encounter_date)($|_)",
     r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2})?$|^\d{1,2}/\d{1,2}/\d{2,4}$"),
    ("telephone", r"(^|_)(phone|tel|telephone|mobile|cell|contact_?number)($|_)", r"^\+?[\d][\d\-().\s]{7,}\d$"),
    ("fax", r"(^|_)fax($|_)", None),
    ("email", r"(^|_)(email|e_?mail)($|_)", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("ssn", r"(^|_)(ssn|social_?security|social)($|_)", r"^\d{3}-?\d{2}-?\d{4}$"),
    ("mrn", r"(^|_)(mrn|medical_?record|med_?rec|record_?number|chart_?number)($|_)", None),
    ("beneficiary", r"(^|_)(beneficiary|health_?plan|member_?id|subscriber|insurance_?id|policy_?number|plan_?id)($|_)", None),
    ("account", r"(^|_)(account|acct|acct_?no|account_?number|iban)($|_)", None),
    ("license", r"(^|_)(license|licence|certificate|cert_?no|npi|dea|permit)($|_)", None),
    ("vehicle", r"(^|_)(vehicle|vin|license_?plate|plate|vehicle_?id)($|_)", r"^[A-HJ-NPR-Z0-9]{17}$"),
    ("device", r"(^|_)(device|serial|serial_?no|device_?id|imei|udi)($|_)", None),
    ("url", r"(^|_)(url|website|link|homepage|uri)($|_)", r"(?i)^https?://\S+$"),
    ("ip", r"(^|_)(ip|ip_?address|ipaddr|ipv4|ipv6)($|_)", r"(?i)^(\d{1,3}\.){3}\d{1,3}$|^[0-9a-f:]{3,}:[0-9a-f:]+$"),
    ("biometric", r"(^|_)(biometric|finger_?print|voice_?print|retina|iris|dna|face_?scan)($|_)", None),
    ("photo", r"(^|_)(photo|photograph|image|face|picture|headshot|selfie|img|avatar)($|_)", None),
]
# Names of other identifiers and of quasi-identifiers.
OTHER_NAME = r"(^|_)(id|uuid|guid|identifier|code|token|api_?key|apikey|ref|reference)($|_)"
QUASI_NAMES = r"(^|_)(age|dob|birth|date_of_birth|sex|gender|zip|zipcode|postal|postcode|race|ethnic|ethnicity|marital|marriage)($|_)"


def scan_identifiers(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Columns that look like identifiers, by name or by half of their values; all patterns in one scan."""
    texts = [f.name for f in df.schema.fields if kind_of(f.dataType) == "text"]
    aggs, checks = [], []
    for c in df.columns:
        nn = f"n{df.columns.index(c)}"
        aggs.append(F.count(col(c)).alias(nn))
        claimed = False
        for cat, name_rx, value_rx in IDENTIFIERS:
            named = bool(re.search(name_rx, c, re.I))
            hits = None
            if value_rx and c in texts:
                hits = f"h{len(checks)}"
                aggs.append(F.count_if(F.trim(col(c)).rlike(value_rx)).alias(hits))
            if named or hits:
                checks.append((cat, c, named, hits, nn))
            claimed = claimed or named
        if re.search(r"(^|_)age($|_)", c, re.I) and kind_of(df.schema[c].dataType) == "number":
            hits = f"h{len(checks)}"
            aggs.append(F.count_if(col(c) > 89).alias(hits))
            checks.append(("dates", c, False, hits, None))
        if not claimed and re.search(OTHER_NAME, c, re.I):
            checks.append(("other", c, True, None, nn))
    rows = []
    for cat, c, named, hits, nn in checks:
        if hits is None:
            frac, found = F.lit(None).cast("double"), F.lit(True)
        elif nn is None:
            frac, found = F.lit(None).cast("double"), F.col(hits) > 0
        else:
            frac = F.coalesce(F.try_divide(F.col(hits).cast("double"), F.col(nn)), F.lit(0.0))
            found = F.lit(named) | (frac >= share)
        rows.append(F.struct(F.lit(cat).alias("category"), F.lit(c).alias("column"), F.lit(named).alias("by_name"), F.round(frac, 6).alias("value_share"), found.alias("found")))
    if not rows:
        return df.sparkSession.createDataFrame([], "category string, column string, by_name boolean, value_share double")
    return stack_structs(df.agg(*aggs), rows).where("found").drop("found")


def quasi_identifiers(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.search(QUASI_NAMES, c, re.I)]


def k_anonymity(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Smallest group of equal quasi-identifiers over all rows, and groups and rows below k."""
    g = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(
        F.count(F.lit(1)).alias("groups"), F.min("n").alias("k_floor"), F.count_if(F.col("n") < k).alias("small_groups"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("rows_at_risk")
    )
    f = F.col("k_floor")
    return s.withColumn("level", F.when(f >= k, "none").when(f == 1, "high").when(f < 3, "medium").otherwise("low"))


def uniform(secret: str, *keys: Column) -> Column:
    """A number in (0, 1) from a keyed digest: fixed on every retry, not to be recomputed without the secret."""
    if not secret:
        raise ValueError("noise needs a secret that is not published with the result")
    inner = F.sha2(F.concat_ws(":", F.lit(secret), *[k.cast("string") for k in keys]), 256)
    digest = F.sha2(F.concat_ws(":", F.lit(secret), inner), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / 2.0**52


def laplace(scale: Column | float, secret: str, *keys: Column) -> Column:
    u = uniform(secret, *keys) - 0.5
    return F.lit(-1.0) * scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def noised_counts(df: DataFrame, group: str, epsilon: float, secret: str) -> DataFrame:
    """Group counts with Laplace noise of scale 1/epsilon, never below zero. The caller keeps ``secret``."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    g = df.groupBy(col(group).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    name = F.coalesce(F.col("key").cast("string"), F.lit("(null)"))
    return g.select("key", F.greatest(F.lit(0.0), F.col("n") + laplace(1 / epsilon, secret, name)).alias("noised"))


def bounded_rows(df: DataFrame, person: str, key: str, secret: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of each person, those with the least keyed draw of ``key``.

    Which rows stay depends on the person's own rows alone, so leaving a person out changes no one else's. Each task
    keeps that many rows of a person before the shuffle, so a person with very many rows fills no task.
    Rows without a person stand for a person each.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    names = fresh_names(df, "who", "draw", "place")
    who, draw, place = (F.col(n) for n in names)
    # a mark keeps a row without a person apart from a person named like its key
    one = F.when(col(person).isNotNull(), F.concat(F.lit("p"), col(person).cast("string"))).otherwise(F.concat(F.lit("k"), F.coalesce(col(key).cast("string"), F.lit(""))))
    drawn = df.withColumns({names[0]: one, names[1]: uniform(secret, F.lit("row"), F.coalesce(col(key).cast("string"), F.lit("(null)")))})
    w = Window.partitionBy(who).orderBy(draw, col(key))
    return drawn.withColumn(names[2], F.row_number().over(w)).where(place <= max_rows).drop(*names)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n in taken:
            n += "_"
        out.append(n)
    return out


def value_bound(df: DataFrame, value: str, secret: str, epsilon: float, max_rows: int, share: float = 0.95) -> Column:
    """A power of two that about ``share`` of the values do not exceed in size, found from noised counts.

    The counts of a fixed grid of powers are noised for ``max_rows`` rows of a person in all, so the bound gives away
    no more than ``epsilon``; it is 0 only where the grid's noised total is not above 0.
    """
    x = F.abs(col(value).cast("double"))
    p = F.when(x <= 2.0**GRID[0], GRID[0]).when(x > 2.0 ** GRID[1], GRID[1]).otherwise(F.ceil(F.log2(x))).cast("int")
    # rounding of the logarithm must not leave a value above its own power of two
    p = F.when((x <= 2.0 ** GRID[1]) & (F.pow(F.lit(2.0), p) < x), p + 1).otherwise(p)
    counts = df.where(usable(value)).groupBy(p.alias("power")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(GRID[0], GRID[1] + 1).select(F.col("id").cast("int").alias("power"))
    noise = laplace(max_rows / epsilon, secret, F.lit("bound"), F.col("power").cast("string"))
    noised = grid.join(counts, "power", "left").select("power", F.greatest(F.lit(0.0), F.coalesce("n", F.lit(0)) + noise).alias("n"))
    # one row for each power of a fixed grid
    ranked = noised.agg(F.sort_array(F.collect_list(F.struct("power", "n"))).alias("g"), F.sum("n").alias("total"))
    upto = lambda i: F.aggregate(F.slice("g", 1, i + 1), F.lit(0.0), lambda s, e: s + e["n"])
    reached = F.filter(F.col("g"), lambda e, i: upto(i) >= share * F.col("total"))
    return ranked.select(F.when(F.col("total") > 0, F.pow(F.lit(2.0), F.element_at(reached, 1)["power"])).otherwise(0.0).alias("bound")).scalar()


def usable(value: str) -> Column:
    x = col(value).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def bounded_sums(df: DataFrame, group: str, value: str, person: str, key: str, secret: str, max_rows: int, bound: Column | float) -> DataFrame:
    """Sums and counts ``(key, total, n)`` of values clipped to the bound, from at most ``max_rows`` rows of a person.

    Leaving out one person changes all totals together by at most ``max_rows * bound`` and all counts by ``max_rows``.
    Nulls and non-finite values count as no row; the group null is a group.
    """
    return _clipped(bounded_rows(df.where(usable(value)), person, key, secret, max_rows), group, value, bound if isinstance(bound, Column) else F.lit(float(bound)))


def _clipped(rows: DataFrame, group: str, value: str, b: Column) -> DataFrame:
    x = col(value).cast("double")
    return rows.groupBy(col(group).alias("key")).agg(F.sum(F.greatest(-b, F.least(b, x))).alias("total"), F.count(F.lit(1)).alias("n"))


def noised_sums(
    df: DataFrame, group: str, value: str, person: str, key: str, epsilon: float, secret: str, max_rows: int = 5, bound: float | None = None, share: float = 0.95
) -> DataFrame:
    """Group sums, counts and means with Laplace noise fitted to what one person can change: ``(key, total, n, mean, bound)``.

    A person's contribution is bounded first, to ``max_rows`` rows and to values within ``bound``; without a given bound
    a fifth of ``epsilon`` finds one (``value_bound``). Sums and counts share the rest evenly; means are their quotient,
    clipped to the bound. ``key`` tells rows apart. Group keys themselves are taken as public.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    if bound is not None and bound <= 0:
        raise ValueError("bound must be positive")
    rows = bounded_rows(df.where(usable(value)), person, key, secret, max_rows)
    b = F.lit(float(bound)) if bound is not None else value_bound(rows, value, secret, epsilon / 5, max_rows, share)
    left = (epsilon if bound is not None else epsilon * 4 / 5) / 2
    g = _clipped(rows, group, value, b).withColumn("bound", b)
    name = F.coalesce(F.concat(F.lit("g"), F.col("key").cast("string")), F.lit("(null)"))
    noised = g.select(
        "key", (F.col("total") + laplace(F.col("bound") * max_rows / left, secret, F.lit("total"), name)).alias("total"),
        F.greatest(F.lit(0.0), F.col("n") + laplace(max_rows / left, secret, F.lit("count"), name)).alias("n"), "bound",
    )
    mean = F.greatest(-F.col("bound"), F.least(F.col("bound"), F.col("total") / F.greatest(F.lit(1.0), F.col("n"))))
    return noised.select("key", "total", "n", mean.alias("mean"), "bound")


def private_histogram(df: DataFrame, column: str, secret: str, bins: int = 20, epsilon: float = 1.0) -> DataFrame:
    """Noised bins ``(bin, low, high, label, weight)`` of a number or category."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    noise = lambda key: F.greatest(F.lit(0.0), F.col("n") + laplace(1 / epsilon, secret, F.lit(column), key))
    if kind_of(df.schema[column].dataType) == "number":
        x = col(column).cast("double")
        s = scalar_row(df, lo=F.min(x), hi=F.max(x))
        width = F.when(s["hi"] > s["lo"], (s["hi"] - s["lo"]) / bins).otherwise(1.0 / bins)
        b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - s["lo"]) / width).cast("int")))
        counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        full = every.join(counts, "bin", "left").fillna(0, ["n"])
        return full.select(
            "bin", (s["lo"] + F.col("bin") * width).alias("low"), (s["lo"] + (F.col("bin") + 1) * width).alias("high"), F.lit(None).cast("string").alias("label"), noise(F.col("bin").cast("string")).alias("weight")
        )
    g = df.groupBy(F.coalesce(col(column).cast("string"), F.lit("(null)")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    return g.select(F.pmod(F.xxhash64("label"), F.lit(2**31 - 1)).cast("int").alias("bin"), none.alias("low"), none.alias("high"), "label", noise(F.col("label")).alias("weight"))


CELLS = 4096
UNIT = 2**20


def synthetic_rows(df: DataFrame, columns: Sequence[str], rows: int, secret: str, epsilon: float = 5.0, bins: int = 20) -> DataFrame:
    """Rows drawn from the noised histogram of each column, columns independent.

    A histogram's entries lie side by side on a line of whole numbers, each as long as its weight;
    a row takes the entry that its keyed draw falls on. The line is cut into ``CELLS`` cells and
    joined by cell, so a column may have any number of categories. Null where all weights are zero.
    """
    out = df.sparkSession.range(rows).select(F.col("id").alias("row_id"))
    for c in columns:
        line, length = _line(private_histogram(df, c, secret, bins, epsilon))
        at = F.floor(uniform(secret, F.col("row_id"), F.lit(c), F.lit("a")) * length).cast("long")
        within = uniform(secret, F.col("row_id"), F.lit(c), F.lit("b"))
        drawn = out.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") * CELLS / F.lit(max(length, 1))).cast("int"))
        met = drawn.join(line, "_cell", "left").where("_from is null or (_at >= _from and _at < _upto)")
        number = kind_of(df.schema[c].dataType) == "number"
        value = F.round(F.col("low") + (F.col("high") - F.col("low")) * within, 4) if number else F.col("label")
        out = met.select(*out.columns, value.alias(c))
    return out


def _line(histogram: DataFrame) -> tuple[DataFrame, int]:
    """The entries with their stretch of the line, once for each cell that it touches, and the line's length."""
    parts = histogram.select("*", F.round(F.col("weight") * UNIT).cast("long").alias("_w"), F.pmod(F.xxhash64("bin", "label"), F.lit(CELLS)).alias("_part")).where("_w > 0")
    length = parts.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    # one row per part: at most CELLS in the one window
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.sum("_w").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("bin", "label").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(starts), "_part").withColumn("_from", F.col("_start") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    placed = placed.withColumn("_upto", F.col("_from") + F.col("_w"))
    cell = lambda x: F.floor(x * CELLS / F.lit(max(length, 1))).cast("int")
    cells = F.sequence(cell(F.col("_from")), cell(F.col("_upto") - 1))
    return placed.select(F.explode(cells).alias("_cell"), "low", "high", "label", "_from", "_upto"), length


def compare_statistics(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sigma and extremes of numeric columns side by side."""

    def stats(d: DataFrame, tag: str) -> DataFrame:
        aggs, rows = [], []
        for i, c in enumerate(columns):
            x = col(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
            rows.append(F.struct(F.lit(c).alias("column"), *[F.round(F.col(f"{p}{i}"), 4).alias(f"{tag}_{n}") for p, n in (("n", "count"), ("m", "mean"), ("s", "sigma"), ("a", "min"), ("b", "max"))]))
        return stack_structs(d.agg(*aggs), rows)

    return stats(real, "real").join(F.broadcast(stats(synthetic, "synthetic")), "column")


MIN_ROWS, RARE_FLOOR, SHIFT = 50, 5, 0.1


def _coarse(x: Column, up: bool) -> Column:
    """Round outwards at the second significant digit."""
    step = F.when(x == 0, 1.0).otherwise(F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 1))
    return (F.ceil(x / step) if up else F.floor(x / step)) * step


def shareable_fingerprint(df: DataFrame, columns: Sequence[str], bins: int = 16, epsilon: float | None = 1.0, secret: str = "") -> DataFrame:
    """Distribution shape without values: rows ``(column, kind, bin, low, high, p)``.

    Bounds are rounded outwards, categories under five rows merge into ``(rare)``, columns
    under fifty values are left out, counts carry Laplace noise, keyed by ``secret``, unless epsilon is None.
    """
    parts = None
    for c in columns:
        number = kind_of(df.schema[c].dataType) == "number"
        nn = df.agg(F.count(col(c))).scalar()
        if number:
            x = col(c).cast("double")
            s = scalar_row(df, lo=_coarse(F.min(x), False), hi=_coarse(F.max(x), True))
            hi = F.when(s["hi"] == s["lo"], s["lo"] + 1).otherwise(s["hi"])
            width = (hi - s["lo"]) / bins
            b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - s["lo"]) / width).cast("int")))
            counts = df.where(x.isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
            every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("b"))
            g = every.join(counts, "b", "left").fillna(0, ["n"]).select(F.col("b").cast("string").alias("bin"), "n", s["lo"].alias("low"), hi.alias("high"))
        else:
            v = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            g = v.groupBy(F.when(F.col("n") >= RARE_FLOOR, F.col("v")).otherwise("(rare)").alias("bin")).agg(F.sum("n").alias("n"))
            none = F.lit(None).cast("double")
            g = g.withColumns({"low": none, "high": none})
        n = F.col("n").cast("double")
        if epsilon is not None:
            n = F.greatest(F.lit(0.0), n + laplace(1 / epsilon, secret, F.lit(c), F.col("bin")))
        g = g.withColumn("n", n)
        total = g.agg(F.sum("n")).scalar()
        row = g.where(nn >= MIN_ROWS).select(
            F.lit(c).alias("column"), F.lit("numeric" if number else "categorical").alias("kind"), "bin", "low", "high", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)).alias("p")
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def compare_shapes(a: DataFrame, b: DataFrame, bins: int = 16) -> DataFrame:
    """Jensen-Shannon divergence per column of two shareable fingerprints, numeric bins re-cut to a common grid."""
    # at most bins or category rows per column: store once, read many times below
    both = cut_lineage(a.select("*", F.lit("a").alias("side")).unionByName(b.select("*", F.lit("b").alias("side"))))
    grid = both.where("kind = 'numeric'").groupBy("column").agg(F.min("low").alias("g0"), F.max("high").alias("g1"), F.max(F.col("bin").cast("int")).alias("_"))
    num = both.where("kind = 'numeric'").join(grid, "column")
    per_side = num.groupBy("column", "side").agg(F.count(F.lit(1)).alias("k"))
    num = num.join(per_side, ["column", "side"])
    src = (F.col("high") - F.col("low")) / F.col("k")
    lo = F.col("low") + F.col("bin").cast("int") * src
    gw = (F.col("g1") - F.col("g0")) / bins
    first = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((lo - F.col("g0")) / gw).cast("int")))
    last = F.greatest(first, F.least(F.lit(bins - 1), F.ceil((lo + src - F.col("g0")) / gw).cast("int") - 1))
    cut = num.withColumns({"_lo": lo, "_src": src, "_gw": gw}).withColumn("cell", F.explode(F.sequence(first, last)))
    left = F.greatest(F.col("_lo"), F.when(F.col("cell") == 0, F.col("_lo")).otherwise(F.col("g0") + F.col("cell") * F.col("_gw")))
    right = F.least(F.col("_lo") + F.col("_src"), F.when(F.col("cell") == bins - 1, F.col("_lo") + F.col("_src")).otherwise(F.col("g0") + (F.col("cell") + 1) * F.col("_gw")))
    share = F.greatest(F.lit(0.0), right - left) / F.col("_src")
    recut = cut.select("column", "side", F.col("cell").cast("string").alias("bin"), (F.col("p") * share).alias("p"))
    flat = recut.unionByName(both.where("kind = 'categorical'").select("column", "side", "bin", "p"))
    pq = flat.groupBy("column", "bin").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "a", F.col("p"))), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.when(F.col("side") == "b", F.col("p"))), F.lit(0.0)).alias("q")
    )
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    j = pq.groupBy("column").agg((0.5 * F.sum(term("p")) + 0.5 * F.sum(term("q"))).alias("jsd"))
    return j.withColumn("differs", F.col("jsd") > SHIFT)


def typed_test_rows(spec: dict[str, tuple], rows: int, spark, seed: int = 1) -> DataFrame:
    """Rows for a schema ``{column: ("id",) | ("number", lo, hi) | ("category", [..]) | ("date", start, days)}``."""
    d = spark.range(rows)
    out = []
    for name, s in spec.items():
        u = uniform(f"{seed}", F.col("id"), F.lit(name))
        if s[0] == "id":
            e = F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 6, "0"))
        elif s[0] == "number":
            e = F.round(F.lit(float(s[1])) + u * (s[2] - s[1]), 2)
        elif s[0] == "category":
            e = F.element_at(F.array(*[F.lit(v) for v in s[1]]), (F.floor(u * len(s[1])) + 1).cast("int"))
        else:
            e = F.date_add(F.lit(s[1]).cast("date"), F.floor(u * s[2]).cast("int"))
        out.append(e.alias(name))
    return d.select(*out)
