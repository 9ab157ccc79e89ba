"""Stream validation and event-time windows over the events table."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions.tables import map_frames, register_table_functions
from plumbline.session import run_folder
from plumbline.sources.files import watch_folder
from plumbline.streaming import validator as V


def daily(t):
    """Events with planted drift: one weekday loses values, another is scaled up."""
    d = F.dayofweek("ts")
    v = F.when((d == 4) & (F.col("event_id") % 3 == 0), None).when(d == 6, F.col("value") * 50).otherwise(F.col("value"))
    return t.events.select("event_id", "ts", v.alias("value"), (F.col("user_id") * 1.0).alias("load"))


DAILY_SQL = """(SELECT event_id, ts, CASE WHEN dayofweek(ts) = 3 AND event_id % 3 = 0 THEN NULL WHEN dayofweek(ts) = 5 THEN value * 50 ELSE value END AS value, user_id * 1.0 AS load FROM events)"""


@query(
    "validate_event_batches",
    f"""WITH e AS {DAILY_SQL}, b AS (SELECT date_trunc('day', ts) AS batch, count(*) AS n, count(*) FILTER (WHERE value IS NULL) / count(*) AS nr, avg(value) AS m, stddev_pop(value) AS sd, avg(load) AS lm, stddev_pop(load) AS ls FROM e GROUP BY 1),
         l AS (SELECT batch, 'value' AS "column", n, nr, m, sd FROM b UNION ALL SELECT batch, 'load', n, 0.0, lm, ls FROM b),
         p AS (SELECT *, lag(n) OVER w AS pn, lag(nr) OVER w AS pr, lag(m) OVER w AS pm, lag(sd) OVER w AS ps FROM l WINDOW w AS (PARTITION BY "column" ORDER BY batch)),
         j AS (SELECT *, coalesce(n < pn * 0.7 OR n > pn * 1.3, false) AS a, coalesce(ps > 0 AND abs(m - pm) > 2.5 * ps, false) AS s, coalesce(nr > pr + 0.1, false) AS k FROM p)
        SELECT CAST(CAST(batch AS DATE) AS VARCHAR) AS batch, "column", n AS "rows", round(nr, 6) AS null_ratio, round(m, 4) AS mean, a AS arrival_anomaly, s AS mean_shift, k AS null_spike, CASE WHEN a OR s THEN 'fail' WHEN k THEN 'warn' ELSE 'pass' END AS status FROM j""",
)
def validate_event_batches(t):
    s = V.validate_windows(daily(t), ["value", "load"], F.date_trunc("day", "ts"))
    return s.select(
        F.col("batch").cast("date").cast("string").alias("batch"), "column", "rows", F.round("null_ratio", 6).alias("null_ratio"), F.round("mean", 4).alias("mean"), "arrival_anomaly", "mean_shift", "null_spike", "status"
    )


def _run(t):
    folder = run_folder(t.spark, "validator")
    v = V.StreamValidator(t.spark, "events", folder, ["value", "user_id"])
    stream = watch_folder(t.spark, t.root, t.events.schema, pattern="events.parquet")
    v.start(stream, folder + "-log").awaitTermination()
    return v


@query("stream_validation", "SELECT 'value' AS \"column\", count(*) AS \"rows\", round(avg(value), 4) AS mean, 'pass' AS status FROM events UNION ALL SELECT 'user_id', count(*), round(avg(user_id), 4), 'pass' FROM events")
def stream_validation(t):
    """The events file read as a stream and validated batch by batch."""
    return _run(t).findings().select("column", "rows", F.round("mean", 4).alias("mean"), "status")


@query("stream_session_totals", "SELECT 'events' AS stream, count(*) AS total_rows, CAST(0 AS BIGINT) AS total_issues FROM events")
def stream_session_totals(t):
    return V.session_totals(_run(t).findings()).select("stream", "total_rows", "total_issues")


@query(
    "batch_changes",
    f"""WITH b AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM {DAILY_SQL} GROUP BY 1), r AS (SELECT CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS batch_id, n FROM b), p AS (SELECT *, lag(n) OVER (ORDER BY batch_id) AS pn FROM r)
        SELECT 'events' AS stream, batch_id, n AS "rows", round(n / pn, 6) AS rate, batch_id % 3 <> 2 AS schema_changed FROM p WHERE pn IS NOT NULL""",
)
def batch_changes(t):
    """Consecutive daily batches, every third one announced with another schema."""
    from pyspark.sql import Window

    s = V.batch_statistics(daily(t), ["value"], F.date_trunc("day", "ts"))
    w = Window.orderBy("batch")  # one row per day
    f = s.withColumn("batch_id", F.row_number().over(w).cast("long"))
    f = f.select(F.lit("events").alias("stream"), "batch_id", "rows", F.when(F.col("batch_id") % 3 == 0, "v2").otherwise("v1").alias("schema"))
    return V.batch_changes(f)


@query(
    "tumbling_windows",
    """SELECT CAST(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2""",
)
def tumbling_windows(t):
    w = V.windowed(t.events, "ts", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 3)}, "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query(
    "sliding_windows",
    """WITH b AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS s, value FROM events), x AS (SELECT s AS start, value FROM b UNION ALL SELECT s - INTERVAL '6 hours', value FROM b)
       SELECT CAST(start AS VARCHAR) AS start, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1""",
)
def sliding_windows(t):
    w = V.windowed(t.events, "ts", [], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}, "12 hours", "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query(
    "session_windows",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
       SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def session_windows(t):
    s = V.sessions(t.events, "ts", ["user_id"], "30 minutes", {"n": F.count(F.lit(1))})
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(
    "stream_windowed_to_table",
    """WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS s, count(*) AS n FROM events GROUP BY 1) SELECT CAST(s AS VARCHAR) AS start, n FROM w WHERE s + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
)
def stream_windowed_to_table(t):
    """A watermarked tumbling window run as a stream in append mode: closed windows only."""
    stream = watch_folder(t.spark, t.root, t.events.schema, pattern="events.parquet")
    w = V.windowed(stream, "ts", [], {"n": F.count(F.lit(1))}, "6 hours", late="1 hour")
    folder = run_folder(t.spark, "windows")
    out = V.run_to_table(w, folder, folder + "-log")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "session_numbers",
    """WITH o AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
       SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM o""",
)
def session_numbers(t):
    """A table function called from SQL over the whole table."""
    register_table_functions(t.spark)
    return t.spark.sql("SELECT event_id, user_id, session FROM number_sessions(TABLE(SELECT event_id, user_id, ts FROM {events}), 'user_id', 'ts', 1800)", events=t.events)


@query(
    "user_code_by_key",
    """SELECT lang, count(*) AS documents, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, max(doc_id) FILTER (WHERE length(coalesce(text, '')) = m) AS longest
       FROM (SELECT *, max(length(coalesce(text, ''))) OVER (PARTITION BY lang) AS m FROM documents) GROUP BY 1""",
)
def user_code_by_key(t):
    """User code over all documents of each language, a batch at a time where they lie, and code that merges what it tells."""

    def totals(frames):
        lang, n, chars, longest = None, 0, 0, (-1, -1)
        for f in frames:
            size = f["text"].fillna("").map(len)
            lang, n, chars = f["lang"].iloc[0], n + len(f), chars + int(size.sum())
            longest = max(longest, max(zip(size.tolist(), f["doc_id"].tolist())))
        yield pd.DataFrame({"lang": pd.Series([lang], dtype=object), "documents": [n], "chars": [chars], "longest": [longest[1]], "size": [longest[0]]})

    def together(frames):
        lang, n, chars, longest = None, 0, 0, (-1, -1)
        for f in frames:
            lang, n, chars = f["lang"].iloc[0], n + int(f["documents"].sum()), chars + int(f["chars"].sum())
            longest = max(longest, max(zip(f["size"].tolist(), f["longest"].tolist())))
        yield pd.DataFrame({"lang": pd.Series([lang], dtype=object), "documents": [n], "chars": [chars], "longest": [longest[1]], "size": [longest[0]]})

    told = "lang string, documents long, chars long, longest long, size long"
    return map_frames(t.documents.select("lang", "doc_id", "text"), totals, told, ["lang"], together).drop("size")
