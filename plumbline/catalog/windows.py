"""Ordered analyses on events and orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import windows as W


@query(
    "top_rows_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rn AS BIGINT) AS row_number FROM
       (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3""",
)
def top_rows_per_group(t):
    d = W.top_per_group(t.lineitem, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 3)
    return d.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "row_number")


@query(
    "split_half_stability",
    """WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events), m AS (SELECT avg(value) FILTER (WHERE rn % 2 = 0) AS a, avg(value) FILTER (WHERE rn % 2 = 1) AS b FROM o)
       SELECT round(a, 6) AS mean_even, round(b, 6) AS mean_odd, round(1 - least(1.0, 2 * abs(a - b) / (abs(a) + abs(b) + 1e-9)), 6) AS stability FROM m""",
)
def split_half_stability(t):
    s = W.split_half(t.events, "value", "ts", "event_id")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    "step_anomalies",
    """WITH o AS (SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL), s AS (SELECT *, abs(value - p) AS step FROM o WHERE p IS NOT NULL),
            m AS (SELECT avg(step) AS mu, stddev_pop(step) AS sd FROM s)
       SELECT event_id AS key, value, p AS prev_value, round((step - mu) / sd, 5) AS z, CASE WHEN (step - mu) / sd >= 4 THEN 'high' ELSE 'medium' END AS severity FROM s, m WHERE (step - mu) / sd >= 3""",
)
def step_anomalies(t):
    return W.step_anomalies(t.events, "value", "ts", "event_id").withColumn("z", F.round("z", 5))


@query(
    "date_gap_anomalies",
    """WITH o AS (SELECT event_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS p FROM events), s AS (SELECT event_id, (u - p) / 86400000000.0 AS g FROM o WHERE p IS NOT NULL),
            m AS (SELECT avg(g) AS mu, stddev_pop(g) AS sd FROM s)
       SELECT event_id AS key, round(g, 8) AS gap_days, round((g - mu) / sd, 5) AS z, CASE WHEN (g - mu) / sd >= 4 THEN 'high' ELSE 'medium' END AS severity FROM s, m WHERE (g - mu) / sd > 2.5""",
)
def date_gap_anomalies(t):
    g = W.date_gaps(t.events, "ts", "event_id")
    return g.withColumns({"z": F.round("z", 5), "gap_days": F.round("gap_days", 8)})


@query(
    "missing_value_runs",
    """WITH o AS (SELECT row_number() OVER (ORDER BY d.doc_id) AS pos, l.quality IS NULL AS blank FROM documents d LEFT JOIN labels l USING (doc_id)),
            b AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM o WHERE blank)
       SELECT 'quality' AS "column", min(pos) AS first_row, count(*) AS length, CASE WHEN count(*) >= 10 THEN 'high' ELSE 'medium' END AS severity FROM b GROUP BY g HAVING count(*) >= 3""",
)
def missing_value_runs(t):
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return W.missing_runs(d, "quality", "doc_id", "doc_id")


@query(
    "category_shift",
    """WITH o AS (SELECT o_orderpriority AS k, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, count(*) OVER () AS n, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderkey % 3 = 0 THEN 'odd' ELSE 'small' END AS category FROM orders),
            g AS (SELECT category, count(*) FILTER (WHERE pos <= n // 2) AS n_first, count(*) FILTER (WHERE pos > n // 2) AS n_second, max(n // 2) AS h FROM o GROUP BY 1)
       SELECT category, n_first, n_second, round(n_first / h, 6) AS share_first, round(n_second / h, 6) AS share_second,
              CASE WHEN abs(n_second - n_first) / h > 0.4 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE abs(n_second - n_first) / h > 0.25 AND (n_first / h > 0.05 OR n_second / h > 0.05)""",
)
def category_shift(t):
    cat = F.when(F.col("o_totalprice") > 200000, "big").when(F.col("o_orderkey") % 3 == 0, "odd").otherwise("small")
    s = W.category_shift(t.orders.withColumn("category", cat), "category", "o_totalprice", "o_orderkey")
    return s.withColumns({"share_first": F.round("share_first", 6), "share_second": F.round("share_second", 6)})


@query(
    "analytic_functions",
    """SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS drk, CAST(ntile(4) OVER w AS BIGINT) AS quartile,
       lag(value) OVER w AS prev_v, lead(value) OVER w AS next_v, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(value) OVER u AS first_v, last_value(value) OVER u AS last_v,
       nth_value(value, 2) OVER u AS second_v, round(sum(value) OVER u, 4) AS running, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS moving
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def analytic_functions(t):
    d = W.analytic_columns(t.events, ["user_id"], ["ts", "event_id"], "value")
    rounded = {"pr": F.round("pr", 6), "cd": F.round("cd", 6), "running": F.round("running", 4), "moving": F.round("moving", 4)}
    return d.withColumns(rounded).drop("ts", "user_id", "event_type", "value", "props")
