"""Drift, snapshots, forecasts and metric history built from yearly slices of the orders table."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import drift as D
from plumbline.plans import profile as P


def rnd(df, names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


def halves(t):
    """Two versions of a table: odd and even orders, the second with shifts planted."""
    k = F.col("o_orderkey")
    a = t.orders.where(k % 2 == 0).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    b = t.orders.where(k % 2 == 1).select(
        "o_orderkey", (F.col("o_totalprice") * 1.6).alias("o_totalprice"), F.when(k % 4 == 1, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.concat(F.lit("x"), F.col("o_orderpriority")).alias("o_orderpriority"),
        F.lit(1).alias("extra"),
    )
    return a, b


HALVES_SQL = """a AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0),
   b AS (SELECT o_orderkey, o_totalprice * 1.6 AS o_totalprice, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus, 'x' || o_orderpriority AS o_orderpriority, 1 AS extra FROM orders WHERE o_orderkey % 2 = 1)"""


@query(
    "fingerprint_drift",
    f"""WITH {HALVES_SQL}, n AS (SELECT count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*) AS r FROM b)
        SELECT 'o_orderstatus' AS "column", 'null_rate' AS drift, round(r, 6) AS measure FROM n WHERE r >= 0.2
        UNION ALL SELECT 'o_orderpriority', 'new_top_values', CAST(least(5, count(DISTINCT o_orderpriority)) AS DOUBLE) FROM b""",
)
def fingerprint_drift(t):
    a, b = halves(t)
    keep = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    return rnd(D.compare_fingerprints(P.fingerprint(a, keep), P.fingerprint(b, keep)), ["measure"])


@query(
    "snapshot_capture",
    """SELECT 's1' AS snapshot_id, 'o_totalprice' AS "column", 'number' AS kind, count(*) AS "rows", count(*) - count(o_totalprice) AS nulls, count(DISTINCT o_totalprice) AS distinct_values, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
       UNION ALL SELECT 's1', 'o_orderstatus', 'text', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL, NULL FROM orders""",
)
def snapshot_capture(t):
    return rnd(D.snapshot(t.orders, "s1", ["o_totalprice", "o_orderstatus"]), ["mean"], 4)


@query(
    "snapshot_diff",
    f"""WITH {HALVES_SQL}, s AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*) FROM b) AS r, (SELECT abs(((SELECT avg(o_totalprice) FROM b) - avg(o_totalprice)) / avg(o_totalprice)) FROM a) AS m)
        SELECT 'extra' AS "column", 'column_added' AS change, 'warn' AS status, CAST(NULL AS DOUBLE) AS delta FROM s UNION ALL SELECT '*', 'column_count_changed', 'warn', 1.0 FROM s
        UNION ALL SELECT 'o_orderstatus', 'null_rate_shifted', CASE WHEN r >= 0.15 THEN 'fail' ELSE 'warn' END, round(r, 6) FROM s WHERE r >= 0.05
        UNION ALL SELECT 'o_totalprice', 'mean_shifted', CASE WHEN m >= 0.5 THEN 'fail' ELSE 'warn' END, round(m, 6) FROM s WHERE m >= 0.2
        UNION ALL SELECT '*', 'row_count_changed', CASE WHEN abs((nb - na) / na) >= 0.2 THEN 'fail' ELSE 'warn' END, round(abs((nb - na) / na), 6) FROM s WHERE abs((nb - na) / na) >= 0.05""",
)
def snapshot_diff(t):
    a, b = halves(t)
    return D.diff_snapshots(D.snapshot(a, "a"), D.snapshot(b, "b"))


@query(
    "version_diff",
    f"""WITH {HALVES_SQL}, x AS (SELECT (SELECT avg(o_totalprice) FROM a) AS ma, (SELECT avg(o_totalprice) FROM b) AS mb, (SELECT avg(o_orderkey) FROM a) AS ka, (SELECT avg(o_orderkey) FROM b) AS kb)
        SELECT 'o_orderkey' AS "column", CAST(0 AS BIGINT) AS null_delta, 0.0 AS null_rate_delta, (SELECT count(DISTINCT o_orderkey) FROM b) - (SELECT count(DISTINCT o_orderkey) FROM a) AS distinct_delta, round(kb - ka, 4) AS mean_delta, 'ok' AS risk FROM x
        UNION ALL SELECT 'o_totalprice', 0, 0.0, (SELECT count(DISTINCT o_totalprice) FROM b) - (SELECT count(DISTINCT o_totalprice) FROM a), round(mb - ma, 4), CASE WHEN abs((mb - ma) / ma) > 0.5 THEN 'breaking' WHEN abs((mb - ma) / ma) > 0.2 THEN 'warn' ELSE 'ok' END FROM x
        UNION ALL SELECT 'o_orderstatus', (SELECT count(*) FROM b WHERE o_orderstatus IS NULL), round((SELECT count(*) FILTER (WHERE o_orderstatus IS NULL) / count(*) FROM b), 4), (SELECT count(DISTINCT o_orderstatus) FROM b) - (SELECT count(DISTINCT o_orderstatus) FROM a), NULL, 'breaking' FROM x
        UNION ALL SELECT 'o_orderpriority', 0, 0.0, (SELECT count(DISTINCT o_orderpriority) FROM b) - (SELECT count(DISTINCT o_orderpriority) FROM a), NULL, 'ok' FROM x
        UNION ALL SELECT 'extra', NULL, NULL, NULL, NULL, 'warn' FROM x""",
)
def version_diff(t):
    a, b = halves(t)
    return D.diff_versions(D.snapshot(a, "a"), D.snapshot(b, "b"))


@query("version_risk", "SELECT 'breaking' AS risk, count(DISTINCT x) AS flagged FROM (SELECT unnest(['o_totalprice', 'o_orderstatus', 'extra']) AS x FROM orders)")
def version_risk(t):
    a, b = halves(t)
    return D.overall_risk(D.diff_versions(D.snapshot(a, "a"), D.snapshot(b, "b")))


def monthly(t):
    m = F.date_trunc("month", "o_orderdate").cast("date").cast("string")
    g = t.orders.groupBy(m.alias("load"), F.col("o_orderpriority").alias("column")).agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    rows = F.array(F.struct(F.lit("mean").alias("kind"), F.col("mean").alias("value")), F.struct(F.lit("rows").alias("kind"), F.col("n").alias("value")))
    return g.select("column", "load", F.explode(rows).alias("s")).select("column", "load", "s.kind", "s.value")


HOLT_SQL = """WITH RECURSIVE g AS (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS load, o_orderpriority AS c, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), last AS (SELECT max(load) AS l FROM g),
   h AS (SELECT c, v, load, row_number() OVER (PARTITION BY c ORDER BY load DESC) AS back FROM g, last WHERE load < l), y AS (SELECT c, v, CAST(row_number() OVER (PARTITION BY c ORDER BY load) AS INTEGER) AS t, CAST(count(*) OVER (PARTITION BY c) AS INTEGER) AS n FROM h),
   f AS (SELECT a.c, 1 AS t, a.v AS level, b.v - a.v AS trend, CAST(0.0 AS DOUBLE) AS sse, a.n FROM y a JOIN y b ON a.c = b.c AND a.t = 1 AND b.t = 2
     UNION ALL SELECT f.c, f.t + 1, 0.5 * y.v + 0.5 * (f.level + f.trend), 0.3 * (0.5 * y.v + 0.5 * (f.level + f.trend) - f.level) + 0.7 * f.trend, f.sse + CASE WHEN f.t >= 2 THEN power(y.v - (f.level + f.trend), 2) ELSE 0 END, f.n FROM f JOIN y ON y.c = f.c AND y.t = f.t + 1),
   e AS (SELECT c, n, level + trend AS fc, trend, sqrt(sse / (n - 2)) AS sd FROM f WHERE t = n), cur AS (SELECT c, v AS actual FROM g, last WHERE load = l)"""


@query(
    "forecast_bands",
    HOLT_SQL
    + """ SELECT e.c AS "column", 'mean' AS kind, CAST(n AS BIGINT) AS loads, round(fc, 3) AS expected, round(fc - 2 * sd, 3) AS low, round(fc + 2 * sd, 3) AS high, round(actual, 3) AS actual, round(trend, 4) AS trend, actual < fc - 2 * sd OR actual > fc + 2 * sd AS outside FROM e JOIN cur ON cur.c = e.c""",
)
def forecast_bands(t):
    s = monthly(t).where("kind = 'mean'")
    last = s.agg(F.max("load")).scalar()
    b = D.forecast_bands(s.where(F.col("load") < last), s.where(F.col("load") == last))
    return rnd(rnd(b, ["expected", "low", "high", "actual"], 3), ["trend"], 4)


@query(
    "expected_range",
    HOLT_SQL
    + """ SELECT e.c AS "column", round(trend / abs(fc - trend) * 100, 4) AS trend_pct, CASE WHEN abs(trend / abs(fc - trend) * 100) < 0.5 THEN 'steady' WHEN trend > 0 THEN 'up' ELSE 'down' END AS direction, NOT (actual < fc - 2 * sd OR actual > fc + 2 * sd) AS within FROM e JOIN cur ON cur.c = e.c""",
)
def expected_range(t):
    s = monthly(t)
    last = s.agg(F.max("load")).scalar()
    b = D.forecast_bands(s.where(F.col("load") < last), s.where(F.col("load") == last))
    return D.expected_range(b).select("column", F.round("trend_pct", 4).alias("trend_pct"), "direction", "within")


@query("tracked_statistics")
def tracked_statistics(t):
    """Tracked series from the fingerprint of each order status slice."""
    f = P.fingerprint(t.orders, ["o_totalprice", "o_orderpriority"]).withColumn("load", F.lit("all"))
    return D.tracked_statistics(f)


@query(
    "status_flips",
    """WITH s AS (SELECT o_orderpriority AS layer, year(o_orderdate) AS y, CASE WHEN avg(o_totalprice) > 250000 THEN 'warn' ELSE 'pass' END AS st FROM orders GROUP BY 1, 2), m AS (SELECT max(y) AS y FROM s)
       SELECT a.layer, a.st AS "from", b.st AS "to" FROM s a JOIN m ON a.y = m.y - 1 JOIN s b ON b.y = m.y AND a.layer = b.layer WHERE a.st <> b.st""",
)
def status_flips(t):
    s = t.orders.groupBy(F.col("o_orderpriority").alias("layer"), F.year("o_orderdate").alias("y")).agg(F.when(F.avg("o_totalprice") > 250000, "warn").otherwise("pass").alias("status"))
    top = s.agg(F.max("y")).scalar()
    return D.status_flips(s.where(F.col("y") == top - 1), s.where(F.col("y") == top))


@query(
    "new_alerts",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS seen, o_orderpriority AS source, CASE WHEN avg(o_totalprice) > 250000 THEN 'warn' ELSE 'pass' END AS severity FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(severity) OVER (PARTITION BY source ORDER BY seen) AS b FROM m)
       SELECT CAST(CAST(seen AS DATE) AS VARCHAR) AS seen, source, severity FROM p WHERE severity = 'warn' AND b IS DISTINCT FROM severity""",
)
def new_alerts(t):
    m = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("seen"), F.col("o_orderpriority").alias("source")).agg(F.when(F.avg("o_totalprice") > 250000, "warn").otherwise("pass").alias("severity"))
    a = m.withColumn("lines", F.array(F.lit("mean over limit"), F.col("source")))
    return D.new_alerts(a, "source", "seen").select(F.col("seen").cast("string").alias("seen"), "source", "severity")


@query(
    "metric_changes",
    """WITH v AS (SELECT o_orderpriority AS metric, year(o_orderdate) AS version, CASE WHEN max(o_totalprice) > 490000 THEN 'sum(x)' ELSE 'avg(x)' END AS definition FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(definition) OVER (PARTITION BY metric ORDER BY version) AS previous FROM v)
       SELECT metric, version, previous, definition FROM p WHERE previous IS NOT NULL AND previous <> definition""",
)
def metric_changes(t):
    v = t.orders.groupBy(F.col("o_orderpriority").alias("metric"), F.year("o_orderdate").alias("version")).agg(F.when(F.max("o_totalprice") > 490000, "sum(x)").otherwise("avg(x)").alias("definition"))
    return D.metric_changes(v)
