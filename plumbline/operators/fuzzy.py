"""Fuzzy duplicate pairs, category clusters, connected components, source convergence."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import expand_abbreviation, jaro_winkler, levenshtein_similarity, signatures
from plumbline.model import col, matching
from plumbline.operators.components import components
from plumbline.session import cut_lineage, tasks

IDENTIFIER_NAME = r"^(id|key|code)$|(_id|_key|_code|_no|_num|_number)$"
NEAR_UNIQUE = 0.9


def is_identifier_name(name: str) -> bool:
    return bool(matching([name], IDENTIFIER_NAME))


def similar_values(
    values: DataFrame, column: str, threshold: float = 0.85, inclusive: bool = False, metric: str = "both"
) -> DataFrame:
    """All pairs of distinct values at or above a similarity: rows ``(value_a, value_b, similarity)``.

    Exact: candidates come from an equi-join on signatures that every qualifying pair must
    share (intact segments for edit distance, rare-token pairs for Jaro-Winkler), so only
    values sharing a signature ever meet, and each meeting pair is scored once.
    """
    v = values.select(col(column).cast("string").alias("v")).where(F.col("v").isNotNull() & (F.col("v") != "")).distinct()
    # signatures are the costly step: spread the values evenly, whatever the upstream partitioning
    n = tasks(values)
    v = v.repartition(n, "v")
    index = v.select("v", F.explode(signatures(threshold, False, metric)("v")).alias("sig"))
    probe = v.select(F.col("v").alias("w"), F.explode(signatures(threshold, True, metric)("v")).alias("sig"))
    # signatures outnumber the values by far: neither side goes through the driver
    met = index.join(probe.hint("merge"), "sig").where(F.col("v") != F.col("w"))
    if metric == "levenshtein":
        # cheap enough to settle where the values meet: only true pairs go on to be deduplicated
        near = levenshtein_similarity(F.col("v"), F.col("w"))
        met = met.where(near >= threshold if inclusive else near > threshold)
    pairs = met.select(F.least("v", "w").alias("value_a"), F.greatest("v", "w").alias("value_b")).distinct().repartition(n)
    a, b = F.col("value_a"), F.col("value_b")
    score = {
        "both": F.greatest(levenshtein_similarity(a, b), jaro_winkler(a, b)),
        "levenshtein": levenshtein_similarity(a, b),
        "jaro_winkler": jaro_winkler(a, b),
    }[metric]
    scored = pairs.withColumn("similarity", score)
    keep = F.col("similarity") >= threshold if inclusive else F.col("similarity") > threshold
    return scored.where(keep)


def fuzzy_duplicates(df: DataFrame, column: str, threshold: float = 0.85, metric: str = "both", guard: bool = True) -> DataFrame:
    """Near-duplicate values of a text column with the rows behind each side."""
    if guard and is_identifier_name(column):
        raise ValueError(f"{column} looks like an identifier; fuzzy matching would merge distinct records")
    freq = df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = similar_values(freq, "v", threshold, metric=metric)
    a = freq.select(F.col("v").alias("value_a"), F.col("n").alias("rows_a"))
    b = freq.select(F.col("v").alias("value_b"), F.col("n").alias("rows_b"))
    return pairs.join(a.hint("merge"), "value_a").join(b.hint("merge"), "value_b").select(
        "value_a", "value_b", "rows_a", "rows_b", F.round("similarity", 3).alias("similarity")
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component label (the smallest member) of every node in an undirected edge list, by contraction."""
    links = edges.select(col(a).alias("a"), col(b).alias("b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def category_clusters(df: DataFrame, column: str, threshold: float = 0.82, guard: bool = True) -> DataFrame:
    """Spelling variants of one category: rows ``(canonical, value, count, merge)``.

    Values join when similar (ignoring case) or when one abbreviates the other; the most
    frequent variant is canonical, ties by value. Identifier-like and near-unique columns hold
    no categories and give no rows.
    """
    freq = (
        df.where(F.trim(col(column).cast("string")) != "")
        .groupBy(col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    schema = "canonical string, value string, count bigint, merge boolean"
    empty = df.sparkSession.createDataFrame([], schema)
    if guard and is_identifier_name(column):
        return empty
    freq = cut_lineage(freq)
    size = freq.agg(F.count(F.lit(1)).alias("d"), F.sum("count").alias("n")).first()
    if size["d"] < 2 or (guard and size["d"] / size["n"] >= NEAR_UNIQUE):
        return empty
    return spelling_clusters(freq.withColumn("column", F.lit("")), threshold).drop("column")


def spelling_clusters(freq: DataFrame, threshold: float = 0.82) -> DataFrame:
    """``category_clusters`` of the counted values of many columns at once: (column, value, count).

    Likeness is worked out once per spelling, whatever columns hold it; only values of one column join.
    """
    named = freq.select("column", "value", F.lower("value").alias("low"))
    close = similar_values(named.select("low").distinct(), "low", threshold, inclusive=True)
    node = F.concat_ws("\u0003", "column", "value")
    sides = [named.select(F.col("column").alias("c"), F.col("low").alias(f"value_{x}"), node.alias(x)) for x in "ab"]
    pairs = close.join(sides[0], "value_a").join(sides[1], ["c", "value_b"])
    # values equal apart from case, and values meeting under their long form, link to one hub each
    hub = F.lower(F.coalesce(expand_abbreviation(F.col("value")), F.trim("value")))
    edge = lambda mark, to: named.select(node.alias("a"), F.concat(F.lit(mark), F.concat_ws("\u0003", F.col("column"), to)).alias("b"))
    edges = pairs.select("a", "b").unionByName(edge("\u0001", hub)).unionByName(edge("\u0002", F.col("low")))
    comp = connected_components(edges)
    members = comp.join(freq.withColumn("node", node), "node").select("label", "column", "value", "count")
    lead = members.groupBy("label").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("canonical"),
    )
    out = members.join(lead.where("size > 1"), "label")
    return out.select("column", "canonical", "value", "count", (F.col("value") != F.col("canonical")).alias("merge"))


def apply_merges(df: DataFrame, column: str, merges: DataFrame, override: Mapping[str, str] | None = None) -> DataFrame:
    """Rewrite variants to their canonical spelling; ``override`` maps a canonical to a chosen one.

    The mapping is bounded by the column's category count and left to Spark to broadcast.
    """
    target = F.col("canonical")
    for old, new in (override or {}).items():
        target = F.when(target == old, new).otherwise(target)
    m = merges.select(F.col("value").alias("_from"), target.alias("_to")).where(F.col("_from") != F.col("_to"))
    j = df.join(m, col(column).cast("string") == F.col("_from"), "left")
    return j.withColumn(column, F.coalesce("_to", col(column).cast("string"))).drop("_from", "_to")


@dataclass(frozen=True)
class Source:
    """One source for convergence: its rows, the keys records can be matched on, its trust."""

    name: str
    df: DataFrame
    keys: tuple[tuple[str, ...], ...]
    trust: float = 0.7


# Trust by kind of origin.
DEFAULT_TRUST = {"excel": 0.9, "csv": 0.9, "upload": 0.85, "api": 0.75, "site": 0.65}
FALLBACK_TRUST = 0.7


def default_trust(kind: str | None = None, trust: float | None = None) -> float:
    if trust is not None:
        return min(1.0, max(0.0, trust))
    return DEFAULT_TRUST.get((kind or "").lower(), FALLBACK_TRUST)


EXACT_NUMBER = r"^[-+]?[0-9]{1,28}(\.[0-9]{1,10})?([eE][+]?[0-9]{1,2})?$"


def normalise(c: Column) -> Column:
    """Comparable text: numbers by exact value (28 digits and 10 decimals at most), other text trimmed and lower-cased, blanks null."""
    t = F.trim(c.cast("string"))
    return F.when(t == "", None).otherwise(F.coalesce(F.when(t.rlike(EXACT_NUMBER), t.try_cast("decimal(38,10)").cast("string")), F.lower(t)))


def converge(sources: Sequence[Source], margin: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Link records of several sources by shared keys, transitively, and resolve disagreements.

    Returns clusters ``(cluster, sources, coverage, has_conflict, escalated)`` and resolutions
    ``(cluster, column, resolved, value, source, margin)``. Only key values are linked, by the records that
    hold several; a record is in the cluster of its first one, so a key shared by very many records
    costs no links. A cluster is one row of aggregates: for each source and column the greatest and the
    least value, which tell the winner and whether another source or value disagrees.
    """
    if len({s.name for s in sources}) != len(sources):
        raise ValueError("duplicate source name")
    records = None
    for i, s in enumerate(sources):
        body = F.to_json(F.struct(*[col(c).cast("string").alias(c) for c in s.df.columns]))
        own = F.unhex(F.md5(F.concat(F.lit(s.name + "\u0001"), body)))
        signs = []
        for key in s.keys:
            if set(key) <= set(s.df.columns):
                parts = [normalise(col(c)) for c in sorted(key)]
                full = F.concat_ws("\u0001", F.lit("\u0002".join(sorted(key))), *parts)
                present = parts[0].isNotNull()
                for p in parts[1:]:
                    present = present & p.isNotNull()
                signs.append(F.when(present, F.unhex(F.md5(full))))
        keys = F.array_compact(F.array(*signs)) if signs else F.array().cast("array<binary>")
        part = s.df.select(keys.alias("keys"), own.alias("own"), F.lit(i).alias("source"), F.array(*[col(c).cast("string") for c in s.df.columns]).alias("values"))
        records = part if records is None else records.unionByName(part)
    first = F.get("keys", F.lit(0))
    links = records.where(F.size("keys") > 1).select(first.alias("a"), F.explode(F.slice("keys", 2, 1 << 20)).alias("b"))
    comp = components(links)
    # records without a key stand for themselves
    placed = records.select(F.coalesce(first, "own").alias("node"), first.isNotNull().alias("keyed"), "source", "values")
    linked = placed.join(comp.hint("merge"), "node", "left").select(F.coalesce("component", "node").alias("label"), "keyed", "source", "values")

    cells = [(i, j, c) for i, s in enumerate(sources) for j, c in enumerate(s.df.columns)]
    of = lambda i, j: F.when(F.col("source") == i, F.get("values", F.lit(j)))
    cell = linked.select("keyed", "label", "source", *[of(i, j).alias(f"v{i}_{j}") for i, j, _ in cells])
    cell = cell.select("*", *[normalise(F.col(f"v{i}_{j}")).alias(f"n{i}_{j}") for i, j, _ in cells])
    most = lambda i, j: F.max(F.when(F.col(f"n{i}_{j}").isNotNull(), F.struct(F.col(f"n{i}_{j}").alias("norm"), F.col(f"v{i}_{j}").alias("value"))))
    wide = cell.groupBy("keyed", "label").agg(
        *[F.max(F.col("source") == i).alias(f"s{i}") for i in range(len(sources))],
        *[x for i, j, _ in cells for x in (most(i, j).alias(f"most{i}_{j}"), F.min(f"n{i}_{j}").alias(f"least{i}_{j}"))],
    )
    columns = list(dict.fromkeys(c for _, _, c in cells))
    tops, seconds = {}, {}
    for k, column in enumerate(columns):
        here = [(i, j) for i, j, c in cells if c == column]
        trust = lambda i: F.lit(float(sources[i].trust))
        held = lambda i, j: F.col(f"most{i}_{j}")
        entry = lambda i, j: F.struct(trust(i).alias("trust"), held(i, j)["norm"].alias("norm"), F.lit(sources[i].name).alias("source"), held(i, j)["value"].alias("value"))  # noqa: E731, B023
        tops[f"top{k}"] = _greatest([F.when(held(i, j).isNotNull(), entry(i, j)) for i, j in here])
        other = lambda i, j: (held(i, j)["norm"] != F.col(f"top{k}.norm")) | (F.col(f"least{i}_{j}") != F.col(f"top{k}.norm"))  # noqa: E731, B023
        seconds[f"second{k}"] = _greatest([F.when(other(i, j), trust(i)) for i, j in here])
    wide = wide.withColumns(tops).withColumns(seconds)
    name = F.concat(F.when(F.col("keyed"), "k").otherwise("r"), F.lower(F.hex("label"))).alias("cluster")
    gap = lambda k: F.col(f"top{k}.trust") - F.col(f"second{k}")
    ok = lambda k: gap(k) >= margin - 1e-12
    found = [
        F.when(F.col(f"second{k}").isNotNull(), F.struct(
            F.lit(c).alias("column"), ok(k).alias("resolved"), F.when(ok(k), F.col(f"top{k}.value")).alias("value"),
            F.when(ok(k), F.col(f"top{k}.source")).alias("source"), F.round(gap(k), 6).alias("margin"),
        ))
        for k, c in enumerate(columns)
    ]
    resolutions = wide.select(name, F.explode(F.array_compact(F.array(*found))).alias("r")).select("cluster", "r.*")
    flags = F.array_compact(F.array(*[F.when(F.col(f"second{k}").isNotNull(), ok(k)) for k in range(len(columns))]))
    present = F.sort_array(F.array_compact(F.array(*[F.when(F.col(f"s{i}"), s.name) for i, s in enumerate(sources)])))
    clusters = wide.select(name, present.alias("sources"), flags.alias("f")).select(
        "cluster", "sources", F.size("sources").cast("long").alias("coverage"), (F.size("f") > 0).alias("has_conflict"), F.exists("f", lambda x: ~x).alias("escalated"),
    )
    return clusters, resolutions


def _greatest(values: Sequence[Column]) -> Column:
    """The greatest of values that may be null, or be one alone."""
    return F.array_max(F.array(*values))


def convergence_summary(clusters: DataFrame) -> DataFrame:
    joined = F.col("coverage") >= 2
    return clusters.agg(
        F.count_if(joined).alias("joined_clusters"),
        F.count_if(joined & F.col("escalated")).alias("needs_human"),
        F.count_if(joined & F.col("has_conflict") & ~F.col("escalated")).alias("auto_resolved"),
    )


def reconcile_claims(claims: DataFrame, trust: Mapping[str, float] | None = None, tie: float = 0.05) -> DataFrame:
    """Settle competing claims ``(entity, field, value, source, confidence)``.

    The most confident claim wins when it leads by more than ``tie``; otherwise the most
    trusted source wins when its trust is not shared; otherwise the field stays unresolved.
    """
    rank = F.lit(None).cast("double")
    for s, v in (trust or {}).items():
        rank = F.when(F.col("source") == s, float(v)).otherwise(rank)
    c = claims.withColumn("_t", rank)
    best = F.max(F.struct(F.col("confidence"), F.col("_t"), F.col("source"), F.col("value")))
    keys = ["entity", "field"]
    lead = c.groupBy(*keys).agg(
        best.alias("c1"), F.count(F.lit(1)).alias("claims"), F.count("confidence").alias("n_conf"), F.count("_t").alias("n_trust"),
        F.max(F.struct(F.col("_t"), F.col("source"), F.col("value"))).alias("t1"),
    )
    # what leads comes along through the grouping, so no side is sorted a second time
    j = c.join(lead.hint("merge"), keys).groupBy(*keys).agg(
        F.max(F.when(~F.struct("confidence", "_t", "source", "value").eqNullSafe(F.col("c1")), F.col("confidence"))).alias("conf2"),
        F.max(F.when(~F.struct("_t", "source", "value").eqNullSafe(F.col("t1")), F.col("_t"))).alias("trust2"),
        *[F.first(x).alias(x) for x in ("c1", "t1", "claims", "n_conf", "n_trust")],
    )
    gap = F.col("c1.confidence") - F.col("conf2")
    by_conf = (F.col("n_conf") == F.col("claims")) & (gap > tie)
    by_trust = (F.col("n_trust") == F.col("claims")) & (F.col("t1._t") > F.col("trust2"))
    how = (
        F.when(F.col("claims") == 1, "single claim").when(by_conf, "confidence").when(by_trust, "source trust").otherwise("unresolved")
    )
    pick = lambda f: F.when(how.isin("single claim", "confidence"), F.col(f"c1.{f}")).when(how == "source trust", F.col(f"t1.{f}"))
    return j.select(*keys, how.alias("decided_by"), pick("source").alias("source"), pick("value").alias("value"), F.when(how == "confidence", F.round(gap, 6)).alias("margin"))
