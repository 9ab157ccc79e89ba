"""Projection, filters, column edits, named metrics, redaction."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import all_of, any_of, col
from plumbline.session import spread

# The shapes that count as sensitive whatever the column is called.
SENSITIVE_PATTERNS = {
    "ssn": ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    "mrn": ("MRN", r"(?i)\b(?:mrn|medical\s+record(?:\s+(?:no|number|#))?)\s*[:#]?\s*[A-Z]?\d{5,}\b"),
    "email": ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "longdigits": ("ID", r"\b\d{9,}\b"),
}
SENSITIVE_NAME = r"race|ethnic|insurance|payer|gender|\bsex\b|^sex|_sex|religion|marital"


def sql(tables: Mapping[str, DataFrame], text: str, metrics: Mapping[str, str] | None = None) -> DataFrame:
    """Run SQL text over the given tables; ``@name`` stands for a named metric's expression.

    The tables are common table expressions before the text, which itself stays as it is; no
    session-wide view is created.
    """
    text = expand_metrics(text, metrics or {}).replace("{", "{{").replace("}", "}}")
    named = [f"`{n.replace('`', '``')}` AS (SELECT * FROM {{t{i}}})" for i, n in enumerate(tables)]
    own = re.match(r"(?i)\s*with\s+(recursive\s+)?", text)
    rest = f", {text[own.end():]}" if own else f" {text}"
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(f"WITH {(own and own[1]) or ''}{', '.join(named)}{rest}", **{f"t{i}": d for i, d in enumerate(tables.values())})


def expand_metrics(text: str, metrics: Mapping[str, str]) -> str:
    """Replace ``@metric`` by its bracketed expression; unknown names stay as they are."""
    return re.sub(r"@([A-Za-z_]\w*)", lambda m: f"({metrics[m[1]]})" if m[1] in metrics else m[0], text)


def metric_value(df: DataFrame, expression: str) -> DataFrame:
    return df.agg(F.expr(expression).alias("value"))


def select_where(
    df: DataFrame,
    columns: Sequence[str] = (),
    where: Sequence[Column] = (),
    group_by: Sequence[str] = (),
    aggregates: Sequence[Column] = (),
    order_by: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """The query builder: columns, conjunction of filters, grouping, order, limit."""
    out = df.where(all_of(list(where))) if where else df
    if group_by or aggregates:
        out = out.groupBy(*[col(c) for c in group_by]).agg(*aggregates)
    elif columns:
        out = out.select(*[col(c) for c in columns])
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(limit) if limit else out


def conjunction(a: Column | None, b: Column | None) -> Column | None:
    if a is None or b is None:
        return a if b is None else b
    return a & b


def filter_in(df: DataFrame, allowed: Mapping[str, Sequence]) -> DataFrame:
    """Keep rows whose value is in the list of every named column; an empty list keeps all."""
    return df.where(all_of([col(c).isin(list(v)) for c, v in allowed.items() if v]))


def clean_name(raw: str) -> str:
    s = re.sub(r"[_\-]+", " ", raw)
    s = re.sub(r"([a-z])([A-Z])", r"\1 \2", s)
    s = re.sub(r"\s*\d+$", "", re.sub(r"^\d+\s*", "", s))
    words = s.split()
    return " ".join(w[0].upper() + w[1:].lower() for w in words) or raw


def rename(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by mapping, or every column to its cleaned name when no mapping is given."""
    if names is None:
        names = {c: clean_name(c) for c in df.columns}
        taken = set()
        for c, n in list(names.items()):
            if n in taken:
                del names[c]
            taken.add(n)
    return df.withColumnsRenamed(dict(names))


def safe_cast(df: DataFrame, column: str, to: str) -> DataFrame:
    """Cast to number, boolean, date or text; text that does not parse moves to ``<column>_raw``."""
    text = F.trim(col(column).cast("string"))
    if to == "number":
        lead = F.regexp_extract(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
        value = F.when(lead != "", lead.try_cast("double"))
    elif to == "boolean":
        low = F.lower(text)
        value = F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    elif to == "date":
        value = F.coalesce(text.try_cast("date"), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"))
    else:
        value = text
    raw = F.when(value.isNull() & (text != ""), text)
    return df.withColumns({f"{column}_raw": raw, column: value})


def calculated(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add a column from a formula with ``{Column}`` references."""
    return df.withColumn(name, F.expr(re.sub(r"\{([^}]+)\}", r"`\1`", formula)))


def sensitive_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if re.search(SENSITIVE_NAME, c, re.IGNORECASE)]


def redacted(text: Column) -> Column:
    for label, pattern in SENSITIVE_PATTERNS.values():
        text = F.regexp_replace(text, pattern, f"[REDACTED:{label}]")
    return text


def redact(df: DataFrame, drop: Sequence[str] | None = None) -> DataFrame:
    """Drop sensitive columns and mask sensitive shapes in every text column."""
    drop = sensitive_columns(df.columns) if drop is None else list(drop)
    kept = df.drop(*drop)
    texts = [f.name for f in kept.schema.fields if f.dataType.simpleString() == "string"]
    return kept.withColumns({c: redacted(col(c)) for c in texts})


def redaction_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Masked occurrences per (column, pattern), patterns applied one after the other."""
    aggs, keys = [], []
    for c in columns:
        text = col(c)
        for name, (label, pattern) in SENSITIVE_PATTERNS.items():
            aggs.append(F.coalesce(F.sum(F.regexp_count(text, F.lit(pattern))), F.lit(0)).alias(f"k{len(keys)}"))
            keys.append((c, name))
            text = F.regexp_replace(text, pattern, f"[REDACTED:{label}]")
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("pattern"), F.col(f"k{i}").cast("long").alias("hits"))
        for i, (c, p) in enumerate(keys)
    ]
    return spread(df.select(*[col(c) for c in columns])).agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def has_sensitive(text: Column) -> Column:
    return any_of([text.rlike(p) for _, p in SENSITIVE_PATTERNS.values()])
