"""Audit trail, history and metric registry queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import audit as H
from plumbline.operators.aggregates import near_descriptions


def chain_log(t):
    """A three-step chain per order, with some steps altered after sealing."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    d0, d1, d2 = F.concat(F.lit("load "), k), F.concat(F.lit("trim "), F.col("o_orderstatus")), F.lit("validate")
    h0 = H.step_hash(F.lit(H.GENESIS), F.lit("load"), d0, none)
    h1 = H.step_hash(h0, F.lit("clean"), d1, none)
    h2 = H.step_hash(h1, F.lit("check"), d2, none)
    bad = F.when(k % 9 == 0, F.lit("trim ?")).otherwise(d1)
    step = lambda i, op, d, p, h: F.struct(F.lit(i).cast("long").alias("step"), F.lit(op).alias("op"), d.alias("description"), none.alias("content"), p.alias("parent_hash"), h.alias("hash"))
    steps = F.array(step(0, "load", d0, F.lit(H.GENESIS), h0), step(1, "clean", bad, h0, h1), step(2, "check", d2, F.when(k % 14 == 0, h0).otherwise(h1), h2))
    return t.orders.select(k.cast("string").alias("dataset"), F.explode(steps).alias("s")).select("dataset", "s.*")


@query(
    "verify_chains",
    """SELECT CAST(o_orderkey AS VARCHAR) AS dataset, CAST(3 AS BIGINT) AS steps, CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 14 = 0 THEN 2 END AS broken_at, NOT (o_orderkey % 9 = 0 OR o_orderkey % 14 = 0) AS valid FROM orders""",
)
def verify_chains(t):
    return H.verify_chains(chain_log(t))


@query(
    "append_chain_step",
    """SELECT dataset, CAST(step AS BIGINT) AS step, op FROM (SELECT '1' AS dataset, 3 AS step, 'export' AS op, (SELECT count(*) FROM orders) AS n) WHERE n > 0""",
)
def append_chain_step(t):
    return H.append_step(chain_log(t), "1", "export", "to csv").select("dataset", "step", "op")


@query(
    "column_blame",
    """WITH s AS (SELECT o_orderkey AS step, CASE o_orderkey % 3 WHEN 0 THEN ['price'] WHEN 1 THEN ['price', 'status'] ELSE ['date'] END AS columns FROM orders), e AS (SELECT step, unnest(columns) AS "column" FROM s)
       SELECT "column", count(*) AS steps, min(step) AS first_step, max(step) AS last_step FROM e GROUP BY 1""",
)
def column_blame(t):
    k = F.col("o_orderkey")
    cols = F.when(k % 3 == 0, F.array(F.lit("price"))).when(k % 3 == 1, F.array(F.lit("price"), F.lit("status"))).otherwise(F.array(F.lit("date")))
    return H.blame(t.orders.select(k.alias("step"), cols.alias("columns")))


@query("merkle_root")
def merkle_root(t):
    d = t.orders.select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("leaf"))
    return H.merkle_root(d, "leaf", "o_orderkey", "o_orderkey")


def memory(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("agent_fix_accepted", "manual_edit", "agent_fix_dismissed", "validation_dismissed", "validation_resolved")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", kind.alias("type"), F.concat(F.lit("u"), F.col("user_id")).alias("actor"), F.col("event_type").alias("dataset"), F.lit("value").alias("column"), F.col("ts").alias("at"))


MEMORY_SQL = """(SELECT event_id, ['agent_fix_accepted', 'manual_edit', 'agent_fix_dismissed', 'validation_dismissed', 'validation_resolved'][CAST(event_id % 5 + 1 AS INTEGER)] AS type, 'u' || CAST(user_id AS VARCHAR) AS actor, event_type AS dataset, ts AS t FROM events)"""


@query(
    "event_log_filter",
    f"SELECT event_id, actor FROM {MEMORY_SQL} WHERE type = 'manual_edit' AND dataset = 'purchase' AND t >= TIMESTAMP '2024-01-03' ORDER BY t DESC, event_id LIMIT 20",
)
def event_log_filter(t):
    from datetime import datetime

    log = memory(t).withColumn("at", F.col("at").cast("timestamp"))
    return H.filter_events(log, type="manual_edit", dataset="purchase", since=datetime(2024, 1, 3), limit=20, tie="event_id").select("event_id", "actor")


@query(
    "event_log_summary",
    f"""SELECT dataset, count(*) AS decisions, count(*) FILTER (WHERE type = 'agent_fix_accepted') AS agent_fixes, count(*) FILTER (WHERE type = 'manual_edit') AS human_edits, count(*) FILTER (WHERE type IN ('agent_fix_dismissed', 'validation_dismissed')) AS dismissals,
        count(*) FILTER (WHERE type = 'validation_resolved') AS resolved, epoch_us(max(t)) AS last_us FROM {MEMORY_SQL} GROUP BY 1""",
)
def event_log_summary(t):
    s = H.summarise_events(memory(t))
    return s.withColumn("last_us", F.unix_micros(F.col("last_activity").cast("timestamp"))).drop("last_activity")


@query(
    "query_history",
    """SELECT event_type AS q, count(*) AS runs, count(DISTINCT user_id) AS authors FROM events GROUP BY 1""",
)
def query_history(t):
    k = F.col("event_id")
    text = F.concat(F.when(k % 2 == 0, "SELECT  *\nFROM ").otherwise("SELECT * FROM "), F.col("event_type"), F.when(k % 3 == 0, " ; ").otherwise(""))
    runs = t.events.select(text.alias("query"), F.col("user_id").cast("string").alias("author"), F.col("ts").alias("at"))
    names = t.events.select(F.col("event_type").alias("q")).distinct().withColumn("signature", F.sha2(F.concat(F.lit("SELECT * FROM "), F.col("q")), 256))
    return H.query_history(runs).join(names, "signature").select("q", "runs", "authors")


@query(
    "metric_registry_duplicates",
    """WITH m AS (SELECT DISTINCT 'm' || CAST(p_partkey % 3 AS VARCHAR) AS n FROM part) SELECT 'm0' AS a, 'm1' AS b FROM m WHERE n = 'm0'""",
)
def metric_registry_duplicates(t):
    """Metric descriptions that say nearly the same thing."""
    words = F.element_at(F.array(F.lit("share of orders returned"), F.lit("Share of orders  returned"), F.lit("average basket size")), (F.col("p_partkey") % 3 + 1).cast("int"))
    m = t.part.select(F.concat(F.lit("m"), F.col("p_partkey") % 3).alias("n"), words.alias("w")).distinct()
    return near_descriptions(m, "n", "w").select("a", "b")


@query("near_part_names")
def near_part_names(t):
    """Distinct part names that say nearly the same thing."""
    d = t.part.select("p_name").distinct()
    return near_descriptions(d, "p_name", "p_name")
