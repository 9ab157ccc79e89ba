"""Joins, key checks and table comparison.

Key checks first collapse each side to one row per key with its count (combined on the
map side), so a key holding a large share of the rows costs one row in the shuffle.
"""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import all_of, col, finding, kind_of, rate_status

FK_WARN, FK_FAIL = 0.001, 0.01
COVERAGE_WARN, COVERAGE_FAIL = 0.95, 0.90
UNIQUE_ENOUGH = 0.98


@dataclass(frozen=True)
class Edge:
    left: str
    right: str
    left_on: str
    right_on: str
    how: str = "inner"


def join_graph(
    tables: Mapping[str, DataFrame],
    edges: Sequence[Edge],
    where: Column | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Equi-join a connected graph of tables, breadth first from the first table.

    Column names that occur in several tables come out as ``table_column``.
    """
    names = list(tables)
    seen: dict[str, int] = {}
    for t in names:
        for c in tables[t].columns:
            seen[c] = seen.get(c, 0) + 1
    out_name = {(t, c): f"{t}_{c}" if seen[c] > 1 else c for t in names for c in tables[t].columns}
    flat = {t: tables[t].select(*[col(c).alias(out_name[t, c]) for c in tables[t].columns]) for t in names}
    flipped = {"left": "right", "right": "left"}
    joined, frontier, result = {names[0]}, [names[0]], flat[names[0]]
    while frontier:
        here = frontier.pop(0)
        for e in edges:
            if e.left == here and e.right not in joined:
                there, a, b, how = e.right, e.left_on, e.right_on, e.how
            elif e.right == here and e.left not in joined:
                there, a, b, how = e.left, e.right_on, e.left_on, flipped.get(e.how, e.how)
            else:
                continue
            on = result[out_name[here, a]] == flat[there][out_name[there, b]]
            result = result.join(flat[there], on, how)
            joined.add(there)
            frontier.append(there)
    missing = [t for t in names if t not in joined]
    if missing:
        raise ValueError(f"tables not connected to {names[0]}: {missing}")
    if where is not None:
        result = result.where(where)
    return result.limit(limit) if limit else result


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    suffix: str = "_B",
    null_safe: bool = False,
) -> DataFrame:
    """Two-table join on text keys; the right key is dropped, clashing right names get ``suffix``."""
    taken = set(left.columns)
    rename = {c: (c + suffix if c in taken else c) for c in right.columns if c != right_on}
    r = right.select(col(right_on).cast("string").alias("_rk"), *[col(c).alias(n) for c, n in rename.items()])
    l = left.withColumn("_lk", col(left_on).cast("string"))
    on = F.col("_lk").eqNullSafe(F.col("_rk")) if null_safe else F.col("_lk") == F.col("_rk")
    out = l.join(r, on, how)
    if how in ("right", "full", "full_outer", "outer"):
        dtype = left.schema[left_on].dataType
        key = F.coalesce(col(left_on), F.col("_rk").try_cast(dtype))
        out = out.withColumn(left_on, key)
    return out.drop("_lk", "_rk")


def key_counts(df: DataFrame, key: str, alias: str = "n", as_text: bool = False) -> DataFrame:
    k = col(key).cast("string") if as_text else col(key)
    return df.where(col(key).isNotNull()).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias(alias))


def check_foreign_key(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, label: str = "", as_text: bool = False
) -> DataFrame:
    """Child rows whose key has no parent: total, orphans, nulls, rate, status and five sample keys."""
    ck = col(child_key).cast("string") if as_text else col(child_key)
    pk = col(parent_key).cast("string") if as_text else col(parent_key)
    kids = child.groupBy(ck.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(pk.alias("k")).where(F.col("k").isNotNull()).distinct().withColumn("found", F.lit(True))
    keyed = F.col("k").isNotNull()
    orphan = keyed & F.col("found").isNull()
    checked = kids.join(parents, "k", "left")
    # the five smallest orphan keys: array_agg over a top-5 keeps the collected set bounded
    sample = (
        checked.where(orphan).select(F.col("k").cast("string").alias("k")).orderBy("k").limit(5)
    )
    sample = sample.agg(F.array_sort(F.collect_list("k"))).scalar()
    out = checked.agg(
        F.coalesce(F.sum(F.when(keyed, F.col("n"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(keyed, 0).otherwise(F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_count"),
        F.count_if(orphan).alias("orphan_keys"),
    )
    rate = F.coalesce(F.try_divide(F.col("orphan_count").cast("double"), F.col("total_rows")), F.lit(0.0))
    return out.select(
        F.lit(label or f"{child_key}->{parent_key}").alias("relation"),
        "total_rows",
        "orphan_count",
        "orphan_keys",
        "null_count",
        F.round(rate, 6).alias("orphan_rate"),
        rate_status(rate, FK_WARN, FK_FAIL).alias("status"),
        sample.alias("orphan_sample"),
    )


def check_join_coverage(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, label: str = ""
) -> DataFrame:
    """Share of child rows with a parent, and share of parent rows that have a child."""
    kids = key_counts(child, child_key, "n_child")
    parents = key_counts(parent, parent_key, "n_parent")
    parent_rows = parent.agg(F.count(F.lit(1))).scalar()
    both = kids.join(parents, "k", "left")
    hit = F.col("n_parent").isNotNull()
    out = both.agg(
        F.coalesce(F.sum("n_child"), F.lit(0)).alias("child_total"),
        F.coalesce(F.sum(F.when(hit, F.col("n_child"))), F.lit(0)).alias("child_matched"),
        F.count_if(hit).alias("parent_matched"),
    ).withColumn("parent_total", parent_rows)
    c_rate = F.try_divide(F.col("child_matched").cast("double"), F.col("child_total"))
    p_rate = F.try_divide(F.col("parent_matched").cast("double"), F.col("parent_total"))
    status = (
        F.when(c_rate.isNull(), "idle")
        .when(c_rate < COVERAGE_FAIL, "fail")
        .when(c_rate < COVERAGE_WARN, "warn")
        .otherwise("pass")
    )
    return out.select(
        F.lit(label or f"{child_key}->{parent_key}").alias("relation"),
        "child_total",
        "child_matched",
        "parent_total",
        "parent_matched",
        F.round(c_rate, 6).alias("child_coverage"),
        F.round(p_rate, 6).alias("parent_coverage"),
        status.alias("status"),
    )


def join_cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Join shape, fan-out and exact output size, from the key counts of both sides."""
    a, b = key_counts(left, left_key, "a"), key_counts(right, right_key, "b")
    rows_a = left.agg(F.count(F.lit(1))).scalar()
    rows_b = right.agg(F.count(F.lit(1))).scalar()
    s = a.join(b, "k", "full").agg(
        F.count("a").alias("left_unique"),
        F.count("b").alias("right_unique"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched_keys"),
        F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("b"))), F.lit(0)).alias("estimate_one_per_left_key"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("output_rows"),
    )
    s = s.withColumn("left_total", rows_a).withColumn("right_total", rows_b)
    lu, ru = F.col("left_unique") == F.col("left_total"), F.col("right_unique") == F.col("right_total")
    shape = F.when(lu & ru, "1:1").when(ru, "N:1").when(lu, "1:N").otherwise("N:N")
    ratio = F.coalesce(F.try_divide(F.col("estimate_one_per_left_key").cast("double"), F.col("left_total")), F.lit(1.0))
    severity = (
        F.when(shape.isin("1:1", "N:1"), "safe")
        .when((shape == "1:N") & (ratio > 5), "warning")
        .when(shape == "1:N", "caution")
        .otherwise("danger")
    )
    return s.select("*", shape.alias("shape"), F.round(ratio, 6).alias("fan_out"), severity.alias("severity"))


ID_LIKE = re.compile(r"\bid\b|_id$|^id_", re.IGNORECASE)


def suggest_keys_by_name(left: Sequence[str], right: Sequence[str]) -> tuple[str, str, str] | None:
    """Join keys from names alone: equal, id-like, equal after dropping punctuation."""
    lower = {c.lower(): c for c in reversed(list(right))}
    for c in left:
        if c.lower() in lower:
            return c, lower[c.lower()], "high"
    ids_l, ids_r = [c for c in left if ID_LIKE.search(c)], [c for c in right if ID_LIKE.search(c)]
    if ids_l and ids_r:
        return ids_l[0], ids_r[0], "medium"
    squash = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    plain = {squash(c): c for c in reversed(list(right))}
    for c in left:
        if squash(c) in plain:
            return c, plain[squash(c)], "medium"
    return None


def value_overlap(left: DataFrame, right: DataFrame, min_overlap: float = 0.3) -> DataFrame:
    """Overlap of the distinct values of every column pair, over whole columns.

    Overlap = shared distinct values / the larger distinct count. One shuffle per side:
    all columns are stacked to ``(column, value)`` and deduplicated together.
    """

    def stacked(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias(name), col(c).cast("string").alias("v")) for c in df.columns]
        long = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
        return long.where(F.col("v").isNotNull()).distinct()

    a, b = stacked(left, "left_column"), stacked(right, "right_column")
    na = a.groupBy("left_column").agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy("right_column").agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, "v").groupBy("left_column", "right_column").agg(F.count(F.lit(1)).alias("shared"))
    # na and nb hold one row per column: bounded by the schema
    out = both.join(F.broadcast(na), "left_column").join(F.broadcast(nb), "right_column")
    overlap = F.col("shared") / F.greatest("na", "nb")
    return out.select("left_column", "right_column", "shared", F.round(overlap, 6).alias("overlap")).where(
        F.col("overlap") > min_overlap
    )


def infer_relationships(tables: Mapping[str, DataFrame]) -> list[Edge]:
    """Foreign keys by name: a column named like another table's first column, whose noun starts that table's name."""
    edges = []
    strip = lambda c: re.sub(r"^[a-z]{1,2}_", "", c.lower())
    for t, df in tables.items():
        for u, other in tables.items():
            if t == u:
                continue
            pk = other.columns[0]
            noun = re.sub(r"_?(id|key)$", "", strip(pk))
            if noun == strip(pk) or not u.lower().startswith(noun):
                continue
            edges += [Edge(t, u, c, pk) for c in df.columns if strip(c) == strip(pk)]
    return edges


def relationship_report(tables: Mapping[str, DataFrame], edges: Sequence[Edge] | None = None) -> DataFrame:
    """Inferred relationships confirmed by coverage: ``certain`` when every child key has a parent."""
    edges = list(edges) if edges is not None else infer_relationships(tables)
    if not edges:
        raise ValueError("no relationships to report")
    parts = []
    for e in edges:
        cov = check_join_coverage(tables[e.left], e.left_on, tables[e.right], e.right_on)
        parts.append(
            cov.select(
                F.lit(e.left).alias("from_table"),
                F.lit(e.left_on).alias("from_column"),
                F.lit(e.right).alias("to_table"),
                F.lit(e.right_on).alias("to_column"),
                F.when(F.col("child_coverage") >= 1, "certain").otherwise("inferred").alias("certainty"),
                "child_coverage",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conflict_findings(df: DataFrame, entity: Sequence[str], code: str, pairs: DataFrame, pair_a: str = "code_a", pair_b: str = "code_b") -> DataFrame:
    """The conflicts of ``conflict_pairs`` as findings: one failed rule per forbidden pair that occurs.

    The count is the number of entities that bill both codes, the rate their share of all entities.
    """
    hits = conflict_pairs(df, entity, code, pairs, pair_a, pair_b)
    every = df.select(*[col(c) for c in entity]).distinct().agg(F.count(F.lit(1))).scalar()
    rule = F.concat_ws("+", "code_a", "code_b")
    detail = F.concat(F.col("row_pairs").cast("string"), F.lit(" pairs of rows"))
    rate = F.coalesce(F.try_divide(F.col("entities").cast("double"), every), F.lit(0.0))
    row = finding("code_conflict", rule, [*entity, code], F.lit("fail"), "hard", F.col("entities"), rate, detail)
    return hits.select(row.alias("r")).select("r.*")


def conflict_pairs(
    df: DataFrame, entity: Sequence[str], code: str, pairs: DataFrame, pair_a: str = "code_a", pair_b: str = "code_b"
) -> DataFrame:
    """Forbidden code pairs billed together for one entity (for example patient and day).

    ``pairs`` is a rule table. Rows are cut to codes that occur in it and collapsed per
    (entity, code); each first code then looks up its partner by an equi-join, so the
    work per entity is bounded by the rules, never by all pairs of its rows.
    """
    ent = [col(c) for c in entity]
    have = df.groupBy(*ent, col(code).cast("string").alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    rules = pairs.select(
        F.least(col(pair_a).cast("string"), col(pair_b).cast("string")).alias("code_a"),
        F.greatest(col(pair_a).cast("string"), col(pair_b).cast("string")).alias("code_b"),
    ).distinct()
    first = have.join(rules, F.col("_code") == F.col("code_a")).select(
        *ent, "code_a", "code_b", F.col("_n").alias("n_a")
    )
    second = have.select(*[c.alias(f"_e{i}") for i, c in enumerate(ent)], F.col("_code"), F.col("_n").alias("n_b"))
    on = all_of([first[c].eqNullSafe(second[f"_e{i}"]) for i, c in enumerate(entity)])
    hits = first.join(second, on & (first["code_b"] == second["_code"]))
    return hits.groupBy("code_a", "code_b").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.col("n_a") * F.col("n_b")).alias("row_pairs")
    )


def near_duplicates(df: DataFrame, keys: Sequence[str], date: str, tolerance_days: int = 3) -> DataFrame:
    """Rows with another row of the same keys 1..tolerance days away.

    Days are collapsed first, so a hot key costs one row per calendar day in its window.
    """
    from pyspark.sql import Window

    day = col(date).cast("date")
    ks = [col(k) for k in keys]
    days = df.where(col(date).isNotNull()).groupBy(*ks, day.alias("_day")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*ks).orderBy("_day")
    gap_prev = F.datediff("_day", F.lag("_day").over(w))
    gap_next = F.datediff(F.lead("_day").over(w), F.col("_day"))
    nearest = F.least(gap_prev, gap_next)
    return (
        days.withColumn("nearest_gap", nearest)
        .where(F.col("nearest_gap") <= tolerance_days)
        .select(*ks, F.col("_day").alias("day"), "rows", F.col("nearest_gap").cast("long").alias("nearest_gap"))
    )


def keyed_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Cell-level diff of two versions: rows ``(key, change, column, from, to)`` without unchanged rows."""
    shared = [c for c in before.columns if c in after.columns and c != key]
    gone = [c for c in before.columns if c not in after.columns]
    new = [c for c in after.columns if c not in before.columns]
    cols = shared + gone + new

    def packed(df: DataFrame, name: str) -> DataFrame:
        cells = [(col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in cols]
        return df.select(col(key).alias("key"), F.struct(*cells).alias(name))

    both = packed(before, "a").join(packed(after, "b"), "key", "full")
    cells = [
        F.when(
            ~col("a")[c].eqNullSafe(col("b")[c]),
            F.struct(F.lit("changed").alias("change"), F.lit(c).alias("column"), col("a")[c].alias("from"), col("b")[c].alias("to")),
        )
        for c in cols
    ]
    none = F.lit(None).cast("string")
    whole = lambda what: F.array(
        F.struct(F.lit(what).alias("change"), none.alias("column"), none.alias("from"), none.alias("to"))
    )
    changes = (
        F.when(F.col("a").isNull(), whole("added"))
        .when(F.col("b").isNull(), whole("removed"))
        .otherwise(F.array_compact(F.array(*cells)))
    )
    return both.select("key", F.explode(changes).alias("d")).select("key", "d.*")


def diff_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row counts of a keyed diff: added, removed, changed, unchanged."""
    cols = [c for c in dict.fromkeys(before.columns + after.columns) if c != key]

    def packed(df: DataFrame, name: str) -> DataFrame:
        cells = [(col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in cols]
        return df.select(col(key).alias("key"), F.struct(*cells).alias(name))

    both = packed(before, "a").join(packed(after, "b"), "key", "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count_if(F.col("a").isNull()).alias("added"),
        F.count_if(F.col("b").isNull()).alias("removed"),
        F.count_if(there & ~same).alias("changed"),
        F.count_if(there & same).alias("unchanged"),
    )


def detect_key(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls and distinct values, and whether it identifies every row."""
    pairs = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in df.columns]
    counts = df.select(F.explode(F.array(*pairs)).alias("x")).groupBy("x.column", "x.v").agg(F.count(F.lit(1)).alias("n"))
    s = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("v").alias("distinct_values"),
    )
    return s.withColumn("is_key", (F.col("nulls") == 0) & (F.col("distinct_values") == F.col("rows")))


def key_set_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str, salt: str = "") -> DataFrame:
    """Sizes of two normalised key sets and of their overlap, compared by salted digest only."""

    def digests(df: DataFrame, key: str) -> DataFrame:
        k = F.lower(F.trim(col(key).cast("string")))
        return df.where(k.isNotNull() & (k != "")).select(F.sha2(F.concat(F.lit(salt), k), 256).alias("h")).distinct()

    a = digests(left, left_key).withColumn("in_a", F.lit(1))
    b = digests(right, right_key).withColumn("in_b", F.lit(1))
    s = a.join(b, "h", "full").agg(
        F.count("in_a").alias("left_keys"),
        F.count("in_b").alias("right_keys"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared_keys"),
    )
    share = F.try_divide(F.col("shared_keys").cast("double"), F.least("left_keys", "right_keys"))
    return s.withColumn("overlap_rate", F.round(share, 6))


def check_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    group_by: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """Risks of a join before it runs: fan-out, key type mismatch, non-additive grouping."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    probes = list(dict.fromkeys([right_on, *[g for g in group_by if g in right.columns]]))
    s = right.agg(F.count(F.lit(1)).alias("rows"), *[distinct(col(c)).alias(f"d{i}") for i, c in enumerate(probes)])
    rows = []
    for i, c in enumerate(probes):
        ratio = F.coalesce(F.try_divide(F.col(f"d{i}").cast("double"), F.col("rows")), F.lit(1.0))
        if c == right_on:
            sev = F.when(ratio < 0.5, "fail").when(ratio < UNIQUE_ENOUGH, "warn").otherwise("pass")
            rows.append(F.struct(F.lit("fan_out").alias("check"), F.lit(c).alias("column"), sev.alias("severity"), F.round(ratio, 6).alias("ratio")))
        if c in group_by:
            sev = F.when(ratio < UNIQUE_ENOUGH, "warn").otherwise("pass")
            rows.append(F.struct(F.lit("additivity").alias("check"), F.lit(c).alias("column"), sev.alias("severity"), F.round(ratio, 6).alias("ratio")))
    same = (kind_of(left.schema[left_on].dataType) == "number") == (kind_of(right.schema[right_on].dataType) == "number")
    rows.append(
        F.struct(
            F.lit("key_type").alias("check"),
            F.lit(right_on).alias("column"),
            F.lit("pass" if same else "warn").alias("severity"),
            F.lit(None).cast("double").alias("ratio"),
        )
    )
    return s.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset comparison of two results: agree or mismatch, and rows only on one side.

    Rows are counted per distinct row on each side, so repeated rows collapse before the shuffle.
    """
    cols = a.columns
    ca = a.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_a"))
    cb = b.select(*[col(c) for c in cols]).groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_b"))
    both = ca.withColumn("_b", F.lit(0).cast("long")).unionByName(cb.withColumn("_a", F.lit(0).cast("long")))
    per = both.groupBy(*[col(c) for c in cols]).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    only = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    s = per.agg(only("_a", "_b").alias("only_left"), only("_b", "_a").alias("only_right"))
    ok = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    return s.withColumn("verdict", F.when(ok, "agree").otherwise("mismatch"))


def lifespan_violations(
    facts: DataFrame, fact_key: str, fact_date: str, people: DataFrame, person_key: str, born: str, died: str | None = None
) -> DataFrame:
    """Facts dated before birth or after death, counted per kind."""
    p = people.select(col(person_key).alias("_pk"), col(born).cast("date").alias("_born"), (col(died).cast("date") if died else F.lit(None).cast("date")).alias("_died"))
    d = facts.select(col(fact_key).alias("_fk"), col(fact_date).cast("date").alias("_d"))
    j = d.groupBy("_fk", "_d").agg(F.count(F.lit(1)).alias("_n")).join(p, F.col("_fk") == F.col("_pk"))
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return j.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("checked"),
        tally(F.col("_d") < F.col("_born")).alias("before_birth"),
        tally(F.col("_d") > F.col("_died")).alias("after_death"),
    )
