"""Joins by order: the nearest earlier or later row, points in intervals, overlapping intervals.

None compares every row with every other. The as-of join merges both sides in range buckets of the
order, within each key, and carries the last match over bucket borders, so a key that holds much
of the table is spread over buckets. Interval joins meet in grid cells as wide as the interval.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import range_buckets, sort_number, with_order
from plumbline.model import all_of, col

POSITIVE = (1 << 62) - 1


def _names(left: DataFrame, right: DataFrame, without: Sequence[str], suffix: str) -> list[tuple[str, str]]:
    """The right side's columns and what they are called beside the left side's."""
    taken = {c.lower() for c in left.columns}
    return [(c, c + suffix if c.lower() in taken else c) for c in right.columns if c not in without]


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), direction: str = "backward", tolerance: float | None = None,
    suffix: str = "_right", buckets: int | None = None,
) -> DataFrame:
    """Every left row with the last right row of the same ``by`` at or before its ``left_on``, or nulls.

    ``direction="forward"`` takes the first one at or after. ``tolerance`` bounds the distance, in
    seconds for times. Null keys and null orders match nothing. Of right rows at the same place the
    one with the smallest digest is taken. Order columns are numbers, dates or times; the right
    side's ``by`` columns are left out, names that both sides have get ``suffix``.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"no direction {direction}")
    keys = [f"_k{i}" for i in range(len(by))]
    turn = -1 if direction == "forward" else 1
    whole = "long" if left.select((sort_number(left, left_on)).alias("t")).schema["t"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "double"
    timed = left.schema[left_on].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    side = lambda df, on: [col(b).alias(k) for b, k in zip(by, keys)] + [(sort_number(df, on).cast(whole) * turn).alias("_t")]
    digest = lambda df: F.xxhash64(*[col(c) for c in df.columns]).bitwiseAND(F.lit(POSITIVE))
    l_row, r_row = F.struct(*[col(c) for c in left.columns]), F.struct(*[col(c) for c in right.columns])
    usable = all_of([col(b).isNotNull() for b in by])
    ok = lambda df, on: usable & sort_number(df, on).isNotNull() & ~F.isnan(sort_number(df, on).cast("double"))
    # at one place right rows come before left ones
    one = left.where(ok(left, left_on)).select(*side(left, left_on), digest(left).alias("_tie"), l_row.alias("_l"))
    two = right.where(ok(right, right_on)).select(*side(right, right_on), (-digest(right) - 1).alias("_tie"), r_row.alias("_r"))
    both = one.unionByName(two, allowMissingColumns=True).withColumn("_m", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).drop("_r")
    b = range_buckets(both, "_t", "_tie", buckets)
    ends = b.where("_m is not null").groupBy("_bucket", *keys).agg(F.max_by("_m", F.struct("_t", "_tie")).alias("_end"))
    # one row for each key and range bucket: the last right row in the buckets before
    places = b.select("_bucket", *keys).distinct().join(ends, ["_bucket", *keys], "left")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    upto = Window.partitionBy("_bucket", *keys).orderBy("_t", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = b.withColumn("_here", F.last("_m", ignorenulls=True).over(upto)).where("_l is not null")
    met = here.join(carried if by else F.broadcast(carried), ["_bucket", *keys]).withColumn("_match", F.coalesce("_here", "_carried"))
    near = F.lit(True) if tolerance is None else F.col("_t") - F.col("_match._t") <= F.lit(tolerance * 1_000_000 if timed else tolerance)
    names = _names(left, right, by, suffix)
    out = [F.when(near, F.col("_match._r")[c]).alias(n) for c, n in names]
    found = met.select(*[F.col("_l")[c].alias(c) for c in left.columns], *out)
    none = left.where(~F.coalesce(ok(left, left_on), F.lit(False)))
    return found.unionByName(none.select(*[col(c) for c in left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in names]))


def _level(length: Column) -> Column:
    """The least power of two, as its exponent, that is larger than a length."""
    return F.greatest(F.lit(0), F.floor(F.log2(length + 1)).cast("int") + 1)


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: Sequence[str] = (), open_start: bool = False, suffix: str = "_interval",
) -> DataFrame:
    """All pairs of a point and an interval of the same ``by`` that holds it, ends included.

    An interval stands in the two cells at most that it touches on the grid of the power of two above
    its length; a point looks into one cell of each width that occurs (64 at most). Each pair is
    found once. ``open_start`` leaves the start out. Nulls and intervals that end before they
    start match nothing. Columns are numbers, dates or times, cut to whole units (microseconds) for
    the grid only.
    """
    ivs = intervals.select(*[col(b).alias(f"_k{i}") for i, b in enumerate(by)], sort_number(intervals, start).alias("_s"), sort_number(intervals, end).alias("_e"), F.struct(*[col(c) for c in intervals.columns]).alias("_i"))
    ivs = ivs.where("_e >= _s").withColumn("_level", _level(F.ceil("_e").cast("double") - F.floor("_s")))
    levels = sorted(r[0] for r in ivs.select("_level").distinct().collect())  # widths: 64 at most
    keys = [f"_k{i}" for i in range(len(by))]
    cell = lambda x, level: F.floor(F.floor(x) / F.pow(F.lit(2.0), level)).cast("long")
    ivs = ivs.withColumn("_cell", F.explode(F.sequence(cell(F.col("_s"), F.col("_level")), cell(F.col("_e"), F.col("_level")))))
    pts = points.select(*[col(b).alias(k) for b, k in zip(by, keys)], sort_number(points, at).alias("_p"), F.struct(*[col(c) for c in points.columns]).alias("_q")).where("_p is not null")
    pts = pts.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_cell", cell(F.col("_p"), F.col("_level")))
    after = F.col("_p") > F.col("_s") if open_start else F.col("_p") >= F.col("_s")
    met = pts.join(ivs, [*keys, "_level", "_cell"]).where(after & (F.col("_p") <= F.col("_e")))
    names = _names(points, intervals, by, suffix)
    return met.select(*[F.col("_q")[c].alias(c) for c in points.columns], *[F.col("_i")[c].alias(n) for c, n in names])


def sums_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, key: str, sums: Sequence[str] = ()) -> DataFrame:
    """Per interval ``key``: ``points`` (how many points it holds, ends included) and the sum of each of ``sums`` over them.

    The pairs of ``points_in_intervals`` added up without listing them: points are added up by place, and an
    interval takes what lies at or before its end less what lies before its start, from one running sum over all
    places. The work is a sort of both tables, however many points an interval holds. Intervals without
    points, with nulls, or that end before they start have no row; rows of one key count together. Sums are of whole numbers.
    """
    place = lambda df, c, cast: sort_number(df, c).cast(cast)
    whole = all(df.select(sort_number(df, c).alias("t")).schema["t"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") for df, c in ((points, at), (intervals, start), (intervals, end)))
    cast = "long" if whole else "double"
    named = [f"_s{i}" for i in range(len(sums))]
    # minus zero equals zero, which a grouping by place knows and an order of doubles too
    pts = points.select(place(points, at, cast).alias("_t"), *[col(c).cast("long").alias(n) for c, n in zip(sums, named)]).where("_t is not null")
    pts = pts.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in named], *[F.count(n).alias(f"_c{n}") for n in named])
    counted = ["_n", *named, *[f"_c{n}" for n in named]]
    ends = intervals.select(col(key).alias("_key"), place(intervals, start, cast).alias("_a"), place(intervals, end, cast).alias("_b")).where("_b >= _a")
    far = F.xxhash64("_key").bitwiseAND(F.lit(POSITIVE))
    # at one place starts come before points, and ends behind them
    sides = F.explode(F.array(F.struct(F.col("_a").alias("_t"), (-far - 1).alias("_tie"), F.lit(-1).alias("_sign")), F.struct(F.col("_b").alias("_t"), (far + 1).alias("_tie"), F.lit(1).alias("_sign"))))
    asked = ends.select("_key", sides.alias("_e")).select("_key", "_e.*", *[F.lit(0).cast("long").alias(c) for c in counted])
    both = asked.unionByName(pts.select("*", F.lit(0).cast("long").alias("_tie")), allowMissingColumns=True)
    ran = with_order(both, "_t", "_tie", running_sum=counted, position=None).where("_sign is not null")
    total = ran.groupBy("_key").agg(*[F.sum(F.col("_sign") * F.col(f"run_{c}")).alias(c) for c in counted]).where("_n > 0")
    # a sum of nulls alone is null
    return total.select(F.col("_key").alias(key), F.col("_n").alias("points"), *[F.when(F.col(f"_c{n}") > 0, F.col(n)).alias(c) for c, n in zip(sums, named)])


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), suffix: str = "_right") -> DataFrame:
    """All pairs of intervals of the same ``by`` that share a point, ends included, each pair once.

    Either the right one starts inside the left one, or the left one starts inside the right one
    behind its start; both are ``points_in_intervals``.
    """
    names = _names(left, right, by, suffix)
    order = [*left.columns, *[n for _, n in names]]
    tag = lambda df, mark, cs: df.select(*[col(c).alias(f"{mark}{i}") for i, c in enumerate(cs)])
    l_cols, r_cols = left.columns, right.columns
    l_own, r_own = tag(left, "_a", l_cols), tag(right, "_b", r_cols)
    l_at, r_at = {c: f"_a{i}" for i, c in enumerate(l_cols)}, {c: f"_b{i}" for i, c in enumerate(r_cols)}
    for i, b in enumerate(by):
        l_own, r_own = l_own.withColumn(f"_by{i}", F.col(l_at[b])), r_own.withColumn(f"_by{i}", F.col(r_at[b]))
    keys = [f"_by{i}" for i in range(len(by))]
    upright = lambda df, at, span: df.where(F.col(at[span[0]]) <= F.col(at[span[1]]))
    l_own, r_own = upright(l_own, l_at, left_span), upright(r_own, r_at, right_span)
    first = points_in_intervals(r_own, l_own, r_at[right_span[0]], l_at[left_span[0]], l_at[left_span[1]], keys)
    second = points_in_intervals(l_own, r_own, l_at[left_span[0]], r_at[right_span[0]], r_at[right_span[1]], keys, open_start=True)
    out = [*[F.col(l_at[c]).alias(c) for c in l_cols], *[F.col(r_at[c]).alias(n) for c, n in names]]
    return first.select(*out).unionByName(second.select(*out)).select(*[col(c) for c in order])
