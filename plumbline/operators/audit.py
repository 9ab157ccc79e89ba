"""Hash-chained step logs, column blame, Merkle roots, event and query history."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import with_order
from plumbline.model import col
from plumbline.session import cut_lineage

GENESIS = "0" * 64
DIGEST = "^[0-9a-f]{64}$"
CHAIN_BLOCK = 1024  # steps


def step_hash(parent: Column, op: Column, description: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", parent, op, description, F.coalesce(content, F.lit(""))), 256)


def append_step(log: DataFrame, dataset: str, op: str, description: str, content: str | None = None) -> DataFrame:
    """The one new row that extends a dataset's chain; reads only that dataset's last step."""
    last = log.where(F.col("dataset") == dataset).agg(F.max(F.struct("step", "hash")).alias("l"))
    parent = F.coalesce(F.col("l.hash"), F.lit(GENESIS))
    step = F.coalesce(F.col("l.step") + 1, F.lit(0)).cast("long")
    c = F.lit(content).cast("string")
    return last.select(
        F.lit(dataset).alias("dataset"), step.alias("step"), F.lit(op).alias("op"), F.lit(description).alias("description"), c.alias("content"), parent.alias("parent_hash"),
        step_hash(parent, F.lit(op), F.lit(description), c).alias("hash"),
    )


def verify_chains(log: DataFrame) -> DataFrame:
    """Per dataset: steps, validity and the first broken step.

    Rows lie in blocks of ``CHAIN_BLOCK`` steps of a dataset, so a chain of any length spreads over
    tasks; the last step of a block lies in the next one too. What a row says of itself is checked where it is,
    so only the two hashes travel, as bytes: a row whose own hash is wrong is broken whatever follows.
    A step whose predecessor is missing must start a chain.
    """
    honest = F.col("hash") == step_hash(F.col("parent_hash"), F.col("op"), F.col("description"), F.col("content"))
    # a parent that is no digest is no step's hash
    parent = F.when(F.col("parent_hash").rlike(DIGEST), F.unhex("parent_hash"))
    broken = F.coalesce(~honest, F.lit(False)) | (F.col("parent_hash").isNotNull() & parent.isNull())
    rows = log.select("dataset", F.col("step").cast("long").alias("step"), parent.alias("parent"), F.when(F.col("hash").rlike(DIGEST), F.unhex("hash")).alias("hash"), broken.alias("broken"))
    block = F.floor(F.col("step") / CHAIN_BLOCK)
    last = F.pmod("step", F.lit(CHAIN_BLOCK)) == CHAIN_BLOCK - 1
    copies = F.when(last, F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(True).alias("own"))))
    laid = rows.withColumn("_c", F.explode(copies)).select("dataset", "_c.b", "_c.own", "step", "parent", "hash", "broken")
    before = Window.partitionBy("dataset", "b").orderBy("step").rangeBetween(-1, -1)
    known = F.col("dataset").isNotNull() & F.col("step").isNotNull()
    prev = F.coalesce(F.when(known, F.max("hash").over(before)), F.unhex(F.lit(GENESIS)))
    seen = laid.withColumn("prev", prev).where("own")
    wrong = F.col("broken") | F.coalesce(F.col("parent") != F.col("prev"), F.lit(False))
    g = seen.groupBy("dataset").agg(F.count(F.lit(1)).alias("steps"), F.min(F.when(wrong, F.col("step"))).alias("broken_at"))
    return g.withColumn("valid", F.col("broken_at").isNull())


def blame(steps: DataFrame, column: str | None = None) -> DataFrame:
    """Steps touching each column: counts, first and last step; or the ordered history of one column."""
    e = steps.withColumn("column", F.explode("columns"))
    if column is not None:
        return e.where(F.col("column") == column).drop("columns").orderBy("step")
    return e.groupBy("column").agg(F.count(F.lit(1)).alias("steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


LEVELS = 8


def merkle_root(df: DataFrame, leaf: str, order: str, key: str) -> DataFrame:
    """Root of the hash tree over leaves in order; an odd last node pairs with itself.

    Nodes fold in fixed groups of 256 (eight tree levels) per pass, so a pass shuffles only
    hashes, no group grows, and a trillion leaves take five passes.
    """
    nodes = with_order(df.select(col(leaf).alias("h"), col(order).alias("_o"), col(key).alias("_k")), "_o", "_k").select((F.col("_pos") - 1).alias("i"), "h")
    n = nodes.count()
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([("L:empty",)], "h string").select(F.sha2("h", 256).alias("root"), F.lit(0).cast("long").alias("leaves"))
    total = n
    while n > 1:
        levels = 0
        while levels < LEVELS and n > 1:
            n = (n + 1) // 2
            levels += 1
        size = 2**levels
        g = nodes.groupBy(F.floor(F.col("i") / size).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("i").alias("p"), "h"))), lambda x: x["h"]).alias("a"))
        a = F.col("a")
        for _ in range(levels):
            g = g.withColumn(
                "a",
                F.transform(
                    F.sequence(F.lit(0), F.ceil(F.size(a) / 2).cast("int") - 1),
                    lambda k: F.sha2(F.concat(F.lit("N:"), F.get(a, k * 2), F.coalesce(F.get(a, k * 2 + 1), F.get(a, k * 2))), 256),
                ),
            )
        nodes = cut_lineage(g.select("i", F.get("a", F.lit(0)).alias("h")))
    return nodes.select(F.col("h").alias("root"), F.lit(total).cast("long").alias("leaves"))


def filter_events(log: DataFrame, type: str | None = None, actor: str | None = None, dataset: str | None = None, column: str | None = None, since: datetime | None = None, until: datetime | None = None, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Events matching every given field, newest first."""
    out = log
    for name, v in (("type", type), ("actor", actor), ("dataset", dataset), ("column", column)):
        if v is not None:
            out = out.where(col(name) == v)
    if since is not None:
        out = out.where(F.col("at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("at") <= F.lit(until))
    out = out.orderBy(F.desc("at"), *([F.asc(tie)] if tie else []))
    return out.limit(limit) if limit is not None else out


def summarise_events(log: DataFrame) -> DataFrame:
    """Counts per dataset: fixes accepted, manual edits, dismissals, resolutions, last activity."""
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    return log.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("decisions"), n("agent_fix_accepted").alias("agent_fixes"), n("manual_edit").alias("human_edits"), n("agent_fix_dismissed", "validation_dismissed").alias("dismissals"), n("validation_resolved").alias("resolved"), F.max("at").alias("last_activity")
    )


def normalise_query(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s*;\s*$", "")


def query_history(runs: DataFrame, text: str = "query", author: str = "author", at: str = "at") -> DataFrame:
    """Runs of the same query by digest of its normalised text: times, authors, first and last run."""
    d = runs.select(F.sha2(normalise_query(col(text)), 256).alias("signature"), col(author).alias("author"), col(at).alias("at"))
    return d.groupBy("signature").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("author").alias("authors"), F.min("at").alias("first_run"), F.max("at").alias("last_run"), F.max_by("author", F.struct("at", "author")).alias("last_author")
    )
