"""Secret scans with corpus-wide ownership frequency.

Candidates are the base patterns' values and other long tokens that look random. Their digests are
counted over the corpus by distinct repositories and owners. A candidate that several owners hold,
or that stands in many repositories, is an example that gets copied; one that a single owner holds
in few repositories looks live, and its place is added to the spans; the rest is shared. Built-in functions only; no value is written anywhere, only digests and lengths.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, written
from plumbline.model import col


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"""({KEYWORD})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so a least length inside the pattern drops the same matches as a filter afterwards.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"  # not across an equals sign: of key=value the value alone
KINDS = ("assign", "access", "hex", "owned")
VERDICTS = ("owned", "shared", "copied")
LEAST_ASSIGNED, LEAST_LIVE = 6, 16
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 10


def looks_random(value: Column) -> Column:
    """Long enough, with letters and at least two digits."""
    return (F.length(value) >= LEAST_LIVE) & value.rlike("[A-Za-z]") & value.rlike("[0-9].*[0-9]")


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches as (gap before it, length, value's length, digest of the value, base span, candidate)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def entry(m: Column, i: Column, gap: Column) -> Column:
        value = F.regexp_extract(m, ASSIGN, 2) if kind == "assign" else m
        base = F.length(value) >= LEAST_ASSIGNED if kind == "assign" else F.lit(kind != "token")
        return F.struct(
            F.lit(kind).alias("kind"),
            gap[i].alias("gap"),
            F.length(m).alias("length"),
            F.length(value).alias("value_length"),
            F.sha2(value, 256).alias("digest"),
            base.alias("base"),
            looks_random(value).alias("candidate"),
        )

    with_gaps = F.transform(F.array(gaps), lambda g: F.transform(found, lambda m, i: entry(m, i, g)))[0]
    return F.when(F.size(found) > 0, with_gaps)


def occurrences(df: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """One row per document: row number, id, owner, repository and its matches of all kinds."""
    t = text_of(text)
    kinds = [matches(t, k, p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))]
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        col(key).alias("doc"),
        col(owner).cast("string").alias("owner"),
        col(repository).cast("string").alias("repository"),
        *[k.alias(f"m{i}") for i, k in enumerate(kinds)],
    )


def spans_of(table: DataFrame) -> DataFrame:
    """One row per match with its place in code points, the end not included."""
    kinds = [table.where(f"m{i} is not null").select("row", "owner", "repository", F.posexplode(f"m{i}").alias("at", "m")) for i in range(4)]
    flat = reduce(DataFrame.unionByName, kinds).select("row", "owner", "repository", "at", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).drop("gap", "at")


def ownership(spans: DataFrame) -> DataFrame:
    """Per candidate digest the numbers of distinct owners and repositories, and the ``verdict`` on it.

    ``copied`` from ``WIDE_OWNERS`` owners or ``WIDE_REPOSITORIES`` repositories on, else ``owned`` by
    one owner, else ``shared``. A missing owner counts as one owner, a missing repository of an owner
    as one repository. Repositories are counted within their owner, so a value that one owner
    holds in very many rows is pre-aggregated by owner and repository first.
    """
    held = spans.where("candidate").select("digest", "owner", "repository").distinct()
    by_owner = held.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    found = by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    wide = (F.col("owners") >= WIDE_OWNERS) | (F.col("repositories") >= WIDE_REPOSITORIES)
    return found.withColumn("verdict", F.when(wide, "copied").when(F.col("owners") == 1, "owned").otherwise("shared"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: ``doc``, counts of base spans by kind, ``base``, ``spans``, ``n_owned``, ``n_shared``, ``n_copied``, ``most_owners``, ``most_repositories``.

    Base spans are whole matches: ``assign`` with a value of 6 characters or more, ``access`` of 20,
    ``hex`` of 24; leftmost, not overlapping within a kind. ``owned`` spans are places of values (of
    base spans and of other tokens of 20 characters or more) that look random and have that verdict
    (see ``ownership``); the same place is given once. ``n_owned``, ``n_shared`` and ``n_copied`` count
    the row's distinct candidates by verdict, ``most_owners`` and ``most_repositories`` are the largest
    counts of any of them, 0 without candidates. Spans are ``kind:start:end`` by start,
    then kind as listed, in code points, the end not included. Null and empty texts have none;
    repeated rows are rows of their own in one repository.
    """
    table = written(occurrences(df, key, text, owner, repository), "secret-matches")
    spans = written(spans_of(table), "secret-spans")
    known = ownership(spans)
    judged = spans.where("candidate").join(known, "digest").select(
        "row", "digest", (F.col("end") - F.col("value_length")).alias("start"), "end", "owners", "repositories", "verdict"
    )
    place = lambda kind, order: F.struct(F.col("start").cast("long").alias("start"), order.alias("order"), kind.alias("kind"), F.col("end").cast("long").alias("end"))
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).otherwise(2)
    base = spans.where("base").select("row", place(F.col("kind"), order).alias("s"))
    owned = judged.select("row", F.when(F.col("verdict") == "owned", place(F.lit("owned"), F.lit(3))).alias("s"), "digest", "owners", "repositories", "verdict")
    distinct = lambda v: F.size(F.collect_set(F.when(F.col("verdict") == v, F.col("digest")))).cast("long").alias(f"n_{v}")
    per_row = base.unionByName(owned, allowMissingColumns=True).groupBy("row").agg(
        F.array_sort(F.collect_set("s")).alias("s"), *map(distinct, VERDICTS), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories")
    )
    joined = table.select("row", "doc").join(per_row, "row", "left")
    all_spans = F.coalesce("s", F.array().cast(per_row.schema["s"].dataType))
    is_base = lambda x: x["order"] < 3
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter(all_spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select(
        "doc",
        *[number(k) for k in KINDS[:3]],
        shown(F.filter(all_spans, is_base)).alias("base"),
        shown(all_spans).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*[f"n_{v}" for v in VERDICTS], "most_owners", "most_repositories")],
    )
