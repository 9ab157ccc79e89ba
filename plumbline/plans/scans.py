"""Shared scans: what layers want of a table, taken together.

A layer states the aggregates that it wants of the whole table and how it tells their values as
findings; all layers' aggregates share passes of a few aggregates each: with more side by side, the
generated code is too large for the JVM to compile, and a row costs many times as much. What a layer
wants alike of every column or pair of columns is one stacked grouping instead, and so is what layers
want by the values of text columns.
Observed metrics would save a pass more, but a repeated stage may count them twice.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.model import col, stack_structs
from plumbline.session import cut_lineage

At = Callable[[str], Column]

#: Aggregates in one pass.
AT_ONCE = 20


@dataclass(frozen=True)
class Each:
    """The same aggregates for each of several items, by a grouping of its own.

    An item gives the columns that ``wants`` are over, named alike in all items; ``derived`` columns are
    worked out from them once per row. A name not in ``empty`` is null where the table has no rows.
    """

    items: Sequence[Mapping[str, Column]]
    wants: Mapping[str, Column]
    derived: Mapping[str, Column] = field(default_factory=dict)
    empty: Mapping[str, int] = field(default_factory=dict)

    def row(self, df: DataFrame, prefix: str) -> DataFrame:
        """One row, ``<prefix><name><item>``."""
        cells = F.array(*[F.struct(F.lit(i).alias("_item"), *[c.alias(n) for n, c in item.items()]) for i, item in enumerate(self.items)])
        rows = df.select(F.explode(cells).alias("_c")).select("_c.*")
        found = rows.select("*", *[c.alias(n) for n, c in self.derived.items()]).groupBy("_item").agg(*[c.alias(n) for n, c in self.wants.items()])
        # one row an item is left
        of = lambda n, i: F.max(F.when(F.col("_item") == i, F.col(n)))
        told = lambda n, i: F.coalesce(of(n, i), F.lit(self.empty[n]).cast("long")) if n in self.empty else of(n, i)
        return found.agg(*[told(n, i).alias(f"{prefix}{n}{i}") for i in range(len(self.items)) for n in self.wants])


@dataclass(frozen=True)
class Part:
    """A layer's share of a scan: named aggregates, and its result structs made from their values."""

    wants: Mapping[str, Column]
    tell: Callable[[At], Sequence[Column]]
    each: Each | None = None

    def told_as(self, convert: Callable[[Column], Column]) -> Part:
        """The same with every result struct converted."""
        return Part(self.wants, lambda at: [convert(r) for r in self.tell(at)], self.each)


def totals(df: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """The wanted aggregates of all parts as one row, ``p<part>_<name>``."""
    wants = [c.alias(f"p{i}_{n}") for i, p in enumerate(parts) for n, c in p.wants.items()]
    rows = [df.agg(*wants[i : i + AT_ONCE]) for i in range(0, len(wants), AT_ONCE)]
    rows += [p.each.row(df, f"p{i}_") for i, p in enumerate(parts) if p.each and p.each.items]
    return reduce(DataFrame.crossJoin, rows)  # of one row each


def told(row: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """The result rows of parts of one struct type, from ``totals``."""
    return stack_structs(row, [r for i, p in enumerate(parts) for r in p.tell(lambda n, i=i: F.col(f"p{i}_{n}"))])


def scan(df: DataFrame, part: Part) -> DataFrame:
    """One part alone."""
    return told(totals(df, [part]), [part])


def as_table(df: DataFrame) -> tuple[DataFrame, Row]:
    """A one-row table, worked out now: the row, and a table of it that reads nothing."""
    row = df.first()
    literals = [F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(df.schema.fields, row)]
    return df.sparkSession.range(0, 1, 1, 1).select(*literals), row


def stacked(df: DataFrame, columns: Sequence[str], carried: Mapping[str, Column]) -> DataFrame:
    """Every row once for each of ``columns``: ``column``, ``value`` (as text), and ``carried``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("_p"), *[c.alias(n) for n, c in carried.items()]).select("_p.column", "_p.value", *carried)


def by_value(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, Column], targets: Sequence[str]) -> DataFrame:
    """Per column and value: ``n``, of the i-th metric ``s<i>`` (sum) and ``c<i>`` (count), of the i-th target ``m<i>`` (missing).

    One pass, written down: layers read the result instead of the table.
    """
    carried = {f"v{i}": m for i, m in enumerate(metrics.values())} | {f"t{i}": col(t).isNull().cast("long") for i, t in enumerate(targets)}
    sums = [x for i in range(len(metrics)) for x in (F.sum(f"v{i}").alias(f"s{i}"), F.count(f"v{i}").alias(f"c{i}"))]
    found = stacked(df, columns, carried).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(f"t{i}").alias(f"m{i}") for i in range(len(targets))])
    return cut_lineage(found)


def staged_sums(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, Column], stages: int = 16) -> DataFrame:
    """The sums of ``by_value`` by another way: rows dealt by a digest, added up in two stages."""
    carried = {f"v{i}": m for i, m in enumerate(metrics.values())} | {"part": F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(stages))}
    first = stacked(df, columns, carried).groupBy("column", "value", "part").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(metrics))])
    return first.groupBy("column", "value").agg(*[F.sum(f"v{i}").alias(f"s{i}") for i in range(len(metrics))])


def disagreements(direct: DataFrame, staged: DataFrame, metrics: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows ``(column, number, mismatches)``: values whose two sums differ."""
    value = lambda t, i: F.coalesce(F.col(f"{t}.s{i}").cast("double"), F.lit(0.0))
    off = [F.count_if(F.abs(value("d", i) - value("s", i)) > tolerance * F.greatest(F.lit(1.0), F.abs(value("d", i)))).alias(f"x{i}") for i in range(len(metrics))]
    same = (F.col("d.column") == F.col("s.column")) & F.col("d.value").eqNullSafe(F.col("s.value"))
    joined = direct.alias("d").join(staged.alias("s"), same, "full")
    counts = joined.groupBy(F.coalesce("d.column", "s.column").alias("column")).agg(*off)
    cells = F.array(*[F.struct(F.lit(m).alias("number"), F.col(f"x{i}").alias("mismatches")) for i, m in enumerate(metrics)])
    return counts.select("column", F.explode(cells).alias("c")).select("column", "c.*")
