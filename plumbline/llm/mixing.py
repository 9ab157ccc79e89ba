"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the words of the mix and a schedule: its weight over training time
from 0 to 1. The schedule's integral, scaled to the source's share, is the source's cumulative
demand. A copy of a document that fills words u to v of its source's demand is due at the time at
which the demand has grown to the middle of u and v: the inverse of the integral. Documents are
range-sorted by that time. Built-in functions only.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import others, text_of, written
from plumbline.model import col

WORD = r"[^\x20\x09-\x0D]+"
SALT = "mix"
RANGES = 4096
# Weight over time of the sources of weights 5, 2, 1, at equal steps: heavy sources early, light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_key(source: Column) -> Column:
    """A key that sorts by code point with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def sizes(df: DataFrame, keep: Sequence[str], text: str, source: str, key: str) -> DataFrame:
    """One narrow row per document: its columns to keep, source key, size in words and place in the shuffled order."""
    order = F.md5(F.concat(F.lit(SALT), F.coalesce(col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.select(
        *[col(k).alias(f"k{i}") for i, k in enumerate(keep)],
        source_key(col(source)).alias("_source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        order.alias("_order"),
    ).withColumn("_range", (F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") * RANGES / 0x1000000).cast("int"))


def targets(per_source: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``weight``, ``class`` and ``target`` of every source.

    ``share`` times all words is dealt out by weight; what exceeds ``most`` times a source's size is
    dealt again to the others until none exceeds it. ``per_source`` has one row per source.
    """
    place = F.row_number().over(Window.orderBy("_source")) - 1  # one row per source, two numbers wide
    ranked = written(
        per_source.withColumn("class", (place % len(weights)).cast("int")).withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("long")
        ),
        "mix-sources",
    )
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget, level, full = share * total, None, F.lit(False)
    while weight:
        level = budget / weight
        full = F.lit(most) * F.col("source_size") < F.col("weight") * F.lit(level)
        taken, left = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if left == weight:
            break
        budget, weight = share * total - most * taken, left
    everything = F.lit(most) * F.col("source_size")
    by_weight = F.col("weight") * F.lit(level if level is not None else 0.0)
    capped = F.lit(True) if not weight else full
    return ranked.withColumn("target", F.when(capped, everything).otherwise(by_weight))


def due(part: Column, schedule: Sequence[float]) -> Column:
    """The time at which a share ``part`` of a schedule's integral has passed; weights at equal steps, linear between."""
    steps = len(schedule) - 1
    areas = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:])]
    whole = sum(areas)
    if whole <= 0 or min(schedule) < 0:
        raise ValueError("a schedule needs weights of 0 or more, one above 0")
    done, pieces = 0.0, []
    for i, (a, b, area) in enumerate(zip(schedule, schedule[1:], areas)):
        if area > 0:
            q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (part * F.lit(whole) - F.lit(done)) / F.lit(area)))
            inside = q * F.lit(a + b) / (F.lit(a) + F.sqrt(F.lit(a * a) + q * F.lit(b * b - a * a)))
            pieces.append((done + area, (F.lit(float(i)) + F.when(q == 0, F.lit(0.0)).otherwise(inside)) / steps))
        done += area
    return reduce(lambda later, x: F.when(part * F.lit(whole) <= F.lit(x[0]), x[1]).otherwise(later), reversed(pieces[:-1]), pieces[-1][1])


def mix(
    df: DataFrame,
    key: str = "doc_id",
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The mix: per document its ``copies`` (lap, words taken, time due), range-sorted by first time due.

    Sources in code point order, null last, take ``weights`` and ``schedules`` in turn. A source's
    documents lie in a fixed shuffled order, by a digest of ``key``; the mix walks along them, again
    from the start if need be, until the source's target is reached, so the last document of a
    lap may be taken in part. Ties go by key digest, then size; repeated rows are documents of
    their own. Null or empty text: size 0, no copies. Columns: ``keep``, size, source_size, target,
    taken, copies, due (null without copies); a column of ``keep`` with the name of one of these is
    left out for it. Other columns of ``df``, whatever their names, play no part.

    A source of any size is walked in parallel: its order is cut in ranges whose totals, at most
    ``RANGES`` for each source, are summed up first.
    """
    keep = others(keep, ("size", "source_size", "target", "taken", "copies", "due"))
    docs = written(sizes(df, keep, text, source, key), "mix-sizes")
    ranges = docs.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shares = targets(ranges.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).join(shares, "_source").drop("_words")
    inside = Window.partitionBy("_source", "_range").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_source", "_range"])
    start = F.col("_before") + F.col("_inside")
    asked = F.floor("target")  # whole words
    laps = F.floor(asked / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    rest = asked - laps * F.col("source_size")

    def copy(lap: Column) -> Column:
        words = F.when(lap < laps, F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), rest - start)))
        middle = (lap * F.col("source_size") + start + words / 2) / F.greatest(asked, F.lit(1))
        time = due(middle, schedules[-1])
        for i in range(len(weights) - 1):
            time = F.when(F.col("class") == i, due(middle, schedules[i])).otherwise(time)
        return F.struct(lap.alias("lap"), words.cast("long").alias("words"), time.alias("due"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), laps), copy), lambda c: c["words"] > 0)
    taken = laps * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    kept = [F.col(f"k{i}").alias(k) for i, k in enumerate(keep)]
    out = placed.select(
        *kept, "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), copies.alias("copies")
    ).withColumn("due", F.get(F.col("copies"), F.lit(0))["due"])
    order = [F.col("due"), *map(col, keep[:1])]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
