"""Run all layers of a table and grade the result.

The layers share scans: passes of a few aggregates each over the whole table, one stacked grouping for
the digits of numbers, one for their correlations, one for
everything by the values of text columns (written down, and read by five layers), one more for its
check, one for each of quantiles, duplicates, gaps by number and order. Only references, code
conflicts and recorded history have passes of their own.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import Rule, col, columns_of_kind, finding, matching, numeric_columns, stack_structs, text_columns
from plumbline.operators.drift import compare_fingerprints, diff_snapshots, snapshot
from plumbline.operators.fuzzy import NEAR_UNIQUE, is_identifier_name, spelling_clusters
from plumbline.operators.joins import check_foreign_key, conflict_findings
from plumbline.plans import checks, layers
from plumbline.plans.profile import fingerprint
from plumbline.plans.scans import Part, as_table, by_value, disagreements, staged_sums, told, totals
from plumbline.session import cut_lineage


def as_finding(layer: Column | str, rule: Column | str, column: Column | str | None, status: Column | str, count: Column, detail: Column | str = "") -> Column:
    """A layer's own result row as a finding."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    row = finding("", c(rule), [], c(status), "soft", count, F.lit(None), detail)
    row = row.withField("layer", c(layer))
    return row if column is None else row.withField("columns", F.array(c(column)))


def as_findings(df: DataFrame, layer: Column | str, rule: Column | str, column: Column | str | None, status: Column | str, count: Column, detail: Column | str = "") -> DataFrame:
    """Bring a layer's own result rows into the findings shape."""
    return df.select(as_finding(layer, rule, column, status, count, detail).alias("r")).select("r.*")


# Column names that the claims layers look for.
STATUS_NAME, DRG_NAME, ICD_NAME = r"status|denial", r"(^|_)(ms_?)?drg", r"icd|diagnosis|(^|_)dx"
CODE_NAME, PERSON_NAME, BIRTH_NAME = r"(^|_)(cpt|hcpcs)|procedure_code", r"patient_?id|member_?id|person_?id", r"birth|dob"


@dataclass(frozen=True)
class History:
    """What earlier runs of a table recorded; layers without their part stay idle."""

    schema: str | None = None
    correlations: Mapping[tuple[str, str], float] | None = None
    row_counts: DataFrame | None = None  # (table, run_id, rows), this run's row included
    fingerprints: DataFrame | None = None
    snapshot: DataFrame | None = None


@dataclass(frozen=True)
class Story:
    """Texts whose numbers must be found among facts."""

    texts: DataFrame
    key: str
    text: str
    facts: DataFrame
    number: str


#: Layers in the order of their report; each gives findings, or one row that says why not.
LAYERS = (
    "unit_tests", "cross_column", "vitals", "temporal", "flags", "drg_icd", "bounds", "semantic_drift", "outliers", "benford", "two_paths", "categorical", "schema", "reproducibility", "correlation",
    "confidence", "freshness", "denial_radar", "code_conflict", "missingness", "equity", "foreign_key", "drift", "snapshot_drift", "row_counts", "stated_numbers",
)


@dataclass
class Run:
    """One table's layers: what they want of the shared scans, what they found, and which have nothing to do."""

    df: DataFrame
    key: str | None
    pack: str
    as_of: Column
    numbers: list[str]
    binary: list[str]
    parts: list[Part] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)
    idle: dict[str, str] = field(default_factory=dict)

    def tell(self, rows: DataFrame, *args) -> None:
        self.found.append(as_findings(rows, *args))

    # ---- shared passes over the table

    def total_layers(self, rules: Sequence[Rule], history: History) -> None:
        """Layers that want aggregates of the whole table."""
        df, parts = self.df, self.parts
        parts.append(layers.unit_tests_part(df, self.key, self.as_of))
        parts.append(checks.rules_part([r for r in rules if set(r.columns) <= set(df.columns)]))
        parts.append(checks.bounds_part(df))
        parts.append(layers.semantic_part(df))
        if self.numbers:
            hits = lambda r: r["iqr_low"] + r["iqr_high"] + r["mad_low"] + r["mad_high"]
            fences = layers.outliers_part(df, self.numbers)
            parts.append(fences.told_as(lambda r: as_finding("outliers", "mad_or_fence", r["column"], F.when(hits(r) > 0, "warn").otherwise("pass"), hits(r))))
            digits = layers.benford_part(self.numbers)
            parts.append(digits.told_as(lambda r: as_finding("benford", "leading_digit", r["column"], r["status"], r["n"], F.coalesce(r["skipped"], r["chi_square"].cast("string")))))
        else:
            self.idle |= {"outliers": "no numbers", "benford": "no numbers"}
        pairs = [(a, b) for i, a in enumerate(self.numbers) for b in self.numbers[i + 1 :]]
        bad = lambda r: r["status"].isin("warn", "fail").cast("long")
        if pairs:
            watched = layers.correlation_part(pairs, history.correlations)
            parts.append(watched.told_as(lambda r: as_finding("correlation", "watchdog", F.concat_ws(" ~ ", r["left"], r["right"]), r["status"], bad(r), r["r"].cast("string"))))
        else:
            self.idle["correlation"] = "fewer than two numbers"
        for c in self.aged:
            age = layers.freshness_part(c, self.as_of, self.pack if self.pack in layers.FRESHNESS else "general")
            st = lambda r: F.when(r["status"] == "fresh", "pass").when(r["status"] == "expired", "fail").otherwise("warn")
            parts.append(age.told_as(lambda r, c=c: as_finding("freshness", "decay", c, st(r), (st(r) != "pass").cast("long"), F.concat_ws(" ", r["multiplier"].cast("string"), r["status"]))))
        if not self.aged:
            self.idle["freshness"] = "no date"
        states = matching(text_columns(df), STATUS_NAME)
        for c in states:
            parts.append(layers.denial_part(c).told_as(lambda r, c=c: as_finding("denial_radar", "denied_share", c, r["status"], r["denied"], r["rate"].cast("string"))))
        if not states:
            self.idle["denial_radar"] = "no status column"

    @property
    def aged(self) -> list[str]:
        return [c for c in columns_of_kind(self.df, "date") if not matching([c], BIRTH_NAME)]

    # ---- one grouping by the values of columns

    def value_layers(self, gaps: tuple[int, Mapping[str, int]], category_columns: Sequence[str] | None) -> None:
        """Layers that want sums and counts by the values of columns: all read one written grouping."""
        df = self.df
        texts = text_columns(df)
        sexes = matching(df.columns, "gender|sex")
        strata = [c for cs in layers.equity_columns(df.columns).values() for c in cs]
        metrics = {c: col(c) for c in self.numbers} | {c: col(c).cast("double") for c in self.binary}
        drivers = [c for c in df.columns if c in texts or c in columns_of_kind(df, "boolean")]
        n, missing = gaps
        targets = [c for c in df.columns if n and layers.MIN_MISSING <= missing[c] / n < 1]
        columns = list(dict.fromkeys([*texts, *sexes, *strata, *drivers]))
        if not columns:
            self.idle |= {"two_paths": "no text column", "categorical": "no text column", "equity": "no group or outcome columns"}
            return self._missingness(gaps, None)
        values = by_value(df, columns, metrics, targets)

        if sexes:
            many = values.where(F.col("column").isin(*sexes)).groupBy("column").agg(F.count("value").alias("d"))
            self.found.append(many.select(layers.too_many_sexes(F.col("column"), F.col("d")).alias("r")).select("r.*"))
        if texts and metrics:
            direct = values.where(F.col("column").isin(*texts))
            off = disagreements(direct, staged_sums(df, texts, metrics), list(metrics))
            self.tell(off, "two_paths", "group_sums", F.col("column"), F.when(F.col("mismatches") > 0, "fail").otherwise("pass"), F.col("mismatches"), F.col("number"))
        else:
            self.idle["two_paths"] = "no text column or number"
        cells = F.array(*[F.struct(F.lit(t).alias("column"), F.col(f"m{i}").alias("missing")) for i, t in enumerate(targets)])
        grouped = values.where(F.col("column").isin(*drivers) & F.col("value").isNotNull()).select(F.col("column").alias("driver"), F.col("value").alias("grp"), "n", cells.alias("cells"))
        by_group = grouped.select("driver", "grp", "n", F.explode("cells").alias("c")).select("driver", "grp", "n", "c.*").where(F.col("driver") != F.col("column")) if targets else None
        self._missingness(gaps, by_group)
        outcomes = [c for c in metrics if c not in strata]
        if strata and outcomes:
            place = {c: i for i, c in enumerate(metrics)}
            each = F.array(*[
                F.struct(F.lit(c).alias("metric"), F.col(f"c{place[c]}").alias("n"), F.try_divide(F.col(f"s{place[c]}").cast("double"), F.col(f"c{place[c]}")).alias("value"), F.lit(c in self.binary).alias("binary"))
                for c in outcomes
            ])
            cells = values.where(F.col("column").isin(*strata) & F.col("value").isNotNull()).select(F.col("column").alias("stratifier"), F.col("value").alias("group"), F.explode(each).alias("m"))
            e = layers.disparities(cells.select("stratifier", "group", "m.*"))
            row = as_finding("equity", F.concat(F.lit("disparity "), F.col("group")), "", F.col("status"), F.col("n"), F.concat(F.col("metric"), F.lit(" "), F.col("measure").cast("string")))
            self.found.append(e.select(row.withField("columns", F.array("stratifier", "metric")).alias("r")).select("r.*"))
        else:
            self.idle["equity"] = "no group or outcome columns"
        self._spelling(values, texts, category_columns)

    def _missingness(self, gaps: tuple[int, Mapping[str, int]], by_group: DataFrame | None) -> None:
        m = layers.missingness_drivers(self.df, missing=gaps, by_group=by_group)
        st = F.when((F.col("classification") == "MAR") | F.col("mnar_caution"), "warn").otherwise("pass")
        self.tell(m, "missingness", F.col("classification"), F.col("column"), st, F.col("missing_count"), F.col("driver"))

    def _spelling(self, values: DataFrame, texts: Sequence[str], given: Sequence[str] | None) -> None:
        """Spelling variants in the given columns, or in all text columns that can hold categories."""
        named = [c for c in (texts if given is None else given) if not is_identifier_name(c)]
        counted = values.where(F.col("column").isin(*named) & (F.trim("value") != "")) if named else None
        sizes = {r.column: (r.d, r.n) for r in counted.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()} if named else {}
        looked = [c for c, (d, n) in sizes.items() if d >= 2 and d / n < NEAR_UNIQUE]
        if looked:
            k = spelling_clusters(counted.where(F.col("column").isin(*looked)).select("column", "value", F.col("n").alias("count")))
            k = k.groupBy("column", "canonical").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(", ", F.sort_array(F.collect_list("value"))).alias("d"))
            self.tell(k, "categorical", "spelling_variants", F.col("column"), "warn", F.col("n"), F.col("d"))
        if not looked:
            self.idle["categorical"] = "no column of categories"

    # ---- layers with reads of their own

    def other_layers(self, refs: Mapping[str, tuple[DataFrame, str]], history: History, story: Story | None) -> None:
        df, spark = self.df, self.df.sparkSession
        status, bad = F.col("status"), F.col("status").isin("warn", "fail").cast("long")
        self.found.append(layers.duplicate_finding(df).where("count > 0"))
        s = layers.schema_fingerprint(df, history.schema)
        self.tell(s, "schema", "fingerprint", None, F.when(status == "recorded", "pass").otherwise(status), (status == "fail").cast("long"), F.col("digest"))
        r = layers.reproducibility(df)
        self.tell(r, "reproducibility", "digest", None, status, F.col("distinct_digests") - 1, F.concat(F.col("runs").cast("string"), F.lit(" runs")))
        dates = columns_of_kind(df, "date")
        if numeric_columns(df) and self.key:
            c = layers.confidence(df, dates[0] if dates else self.key, self.key)
            self.tell(c, "confidence", "signals", None, status, bad, F.concat(F.col("score").cast("string"), F.lit(" "), F.col("grade")))
        else:
            self.idle["confidence"] = "no key or number"
        codes, people = matching(df.columns, CODE_NAME), matching(df.columns, PERSON_NAME)
        for c in codes:
            for who in people:
                for day in self.aged:
                    self.found.append(conflict_findings(df, [who, day], c, checks.forbidden_pairs(spark)))
        if not (codes and people and self.aged):
            self.idle["code_conflict"] = "no procedure code, person and date"
        for c, (parent, parent_key) in refs.items():
            self.tell(check_foreign_key(df, c, parent, parent_key), "foreign_key", F.col("relation"), c, status, F.col("orphan_count"), F.concat_ws(", ", "orphan_sample"))
        if not refs:
            self.idle["foreign_key"] = "no references given"
        if history.fingerprints is not None:
            self.tell(compare_fingerprints(history.fingerprints, fingerprint(df)), "drift", F.col("drift"), F.col("column"), "warn", F.lit(1), F.col("measure").cast("string"))
        else:
            self.idle["drift"] = "no fingerprints recorded"
        if history.snapshot is not None:
            self.tell(diff_snapshots(history.snapshot, snapshot(df, "now")), "snapshot_drift", F.col("change"), F.col("column"), status, F.lit(1), F.col("delta").cast("string"))
        else:
            self.idle["snapshot_drift"] = "no snapshot recorded"
        if history.row_counts is not None:
            self.tell(layers.row_count_drift(history.row_counts), "row_counts", "history", None, status, F.coalesce(F.abs(F.col("current") - F.col("previous")), F.lit(0)), F.col("table"))
        else:
            self.idle["row_counts"] = "no runs recorded"
        if story is not None:
            said = layers.stated_numbers(story.texts, story.key, story.text, story.facts, story.number)
            n = said.agg(F.count(F.lit(1)).alias("n"))
            self.tell(n, "stated_numbers", "unsupported", story.text, F.when(F.col("n") > 0, "warn").otherwise("pass"), F.col("n"))
        else:
            self.idle["stated_numbers"] = "no texts given"


def validate(
    df: DataFrame, key: str | None = None, rules: Sequence[Rule] = (), pack: str = "none", as_of: Column | None = None,
    category_columns: Sequence[str] | None = None, numbers: Sequence[str] | None = None, binary_columns: Sequence[str] = (),
    refs: Mapping[str, tuple[DataFrame, str]] | None = None, history: History | None = None, story: Story | None = None,
) -> DataFrame:
    """All findings of one table, from shared scans that are made now.

    Every layer of ``LAYERS`` (and those of ``rules``) has a row: its findings, ``no finding`` (pass)
    where it looked and found none, or ``not run`` (idle) and why. ``numbers`` are the numeric columns
    to judge, all by default, ``category_columns`` those looked through for spelling variants, by
    default all text columns that are neither identifiers nor near unique. ``refs`` gives the parent
    table and key of each referring column, ``history`` what earlier runs recorded, ``story`` texts
    to check.
    """
    spark = df.sparkSession
    numbers = list(numbers) if numbers is not None else numeric_columns(df)
    history = history or History()
    run = Run(df, key, pack, as_of if as_of is not None else F.current_date(), numbers, list(binary_columns))
    drg, icd = matching(df.columns, DRG_NAME), matching(df.columns, ICD_NAME)
    coded = [x for g in drg for d in icd for x in checks.drg_rules(g, d)]
    kinds = {
        "cross_column": checks.cross_column_rules(df), "vitals": checks.vital_rules(df), "temporal": checks.temporal_rules(df.columns), "flags": checks.flag_rules(), "drg_icd": coded,
    }
    every = [*[r for rs in kinds.values() for r in rs], *rules]
    present = {r.layer for r in every if set(r.columns) <= set(df.columns)}
    run.idle |= {k: "no columns for its rules" for k in kinds if k not in present}
    run.total_layers(every, history)
    missing = layers.missing_part(df.columns)
    row, taken = as_table(totals(df, [*run.parts, missing]))
    found = told(row, run.parts).where("not (layer = 'unit_tests' and count = 0) and not (layer = 'bounds' and status = 'idle') and not (layer = 'semantic_drift' and status = 'pass')")
    run.found.append(found)
    at = len(run.parts)
    run.value_layers((taken[f"p{at}_n"], {c: taken[f"p{at}_m{i}"] for i, c in enumerate(df.columns)}), category_columns)
    run.other_layers(refs or {}, history, story)
    told_rows = cut_lineage(reduce(DataFrame.unionByName, run.found))
    seen = {r.layer for r in told_rows.select("layer").distinct().collect()}  # names of layers
    rest = [(k, "not run", "idle", run.idle[k]) if k in run.idle else (k, "no finding", "pass", "") for k in LAYERS if k not in seen]
    structs = [as_finding(layer, rule, None, status, F.lit(0), why) for layer, rule, status, why in rest]
    if structs:
        told_rows = told_rows.unionByName(stack_structs(spark.range(0, 1, 1, 1), structs))
    return layers.apply_pack(told_rows, pack, binary_columns)
