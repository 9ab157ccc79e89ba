"""Parsing and scanning: text derived from the shared tables is parsed back and checked."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.plans import layers as L
from plumbline.sources import documents as D
from plumbline.sources import files as S
from plumbline.sources import messages as M
from plumbline.sources import nested as N
from plumbline.sources import warehouse as W


def csv_lines(t):
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    key = F.when(k % 37 == 0, "oops").otherwise(k.cast("string"))
    return t.orders.select(F.concat_ws(",", key, F.col("o_custkey").cast("string"), F.col("o_orderstatus"), price).alias("line"))


@query(
    "csv_rows_accepted",
    "SELECT status, count(*) AS n, CAST(sum(custkey) AS BIGINT) AS keys, round(sum(price), 2) AS total FROM (SELECT o_orderstatus AS status, CAST(o_custkey AS BIGINT) AS custkey, o_totalprice AS price FROM orders WHERE o_orderkey % 37 <> 0) GROUP BY 1",
)
def csv_rows_accepted(t):
    good, _ = S.parse_csv_lines(csv_lines(t), "line", "orderkey bigint, custkey bigint, status string, price double")
    return good.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("custkey").alias("keys"), F.round(F.sum("price"), 2).alias("total"))


@query("csv_rows_rejected", "SELECT count(*) FILTER (WHERE o_orderkey % 37 <> 0) AS accepted, count(*) FILTER (WHERE o_orderkey % 37 = 0) AS rejected FROM orders")
def csv_rows_rejected(t):
    return S.parse_csv_lines(csv_lines(t), "line", "orderkey bigint, custkey bigint, status string, price double")[1]


@query(
    "json_column_scan",
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1",
)
def json_column_scan(t):
    d = N.parse_json_column(t.events, "props")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("json.k").alias("k_sum"))


@query("parquet_projection_filter", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount > 0.07 AND l_quantity < 10")
def parquet_projection_filter(t):
    d = S.load_parquet(t.spark, f"{t.root}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_discount", "l_quantity"])
    return d.where("l_discount > 0.07 AND l_quantity < 10").select("l_orderkey", "l_extendedprice")


@query("scan_by_extension", "SELECT count(*) AS n FROM customer")
def scan_by_extension(t):
    return S.load_any(t.spark, f"{t.root}/customer.parquet").agg(F.count(F.lit(1)).alias("n"))


@query(
    "promote_types",
    """SELECT CAST(o_orderkey AS DOUBLE) AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS status FROM orders""",
)
def promote_types(t):
    text = t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"))
    return S.promote_types(text).withColumn("day", F.col("day").cast("string"))


@query(
    "text_lines",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS content, generate_subscripts(a, 1) AS line_number FROM l)
        SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, md5(regexp_replace(content, '\r$', '')) AS digest FROM u WHERE trim(content, ' ') <> ''""",
)
def text_lines(t):
    d = S.text_lines(t.documents, "doc_id", "text", skip_empty=True)
    return d.select("doc_id", "line_number", F.md5("content").alias("digest"))


@query(
    "text_kinds",
    r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), chr(13) || '$', '') AS c FROM documents),
             g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(c, '^\d{4}-\d{2}-\d{2}|^\[\d{2}[:/]\d{2}')) AS t,
                     count(*) FILTER (WHERE regexp_matches(c, '(?i)\b(INFO|WARN|WARNING|ERROR|DEBUG|CRITICAL|FATAL|TRACE)\b')) AS s,
                     count(*) FILTER (WHERE regexp_matches(c, '\t|,\S')) AS d, count(*) FILTER (WHERE length(trim(c)) > 40) AS p FROM l GROUP BY 1)
        SELECT CASE WHEN t >= 3 OR s >= 3 THEN 'log' WHEN d >= floor(n * 0.7) THEN 'delimited' WHEN p = n THEN 'prose' ELSE 'unknown' END AS kind, count(*) AS n FROM g GROUP BY 1""",
)
def text_kinds(t):
    k = S.text_kind(S.text_lines(t.documents, "doc_id", "text"), "doc_id")
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def payloads(t):
    """One nested JSON payload per customer."""
    body = F.struct(
        F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("tags")).alias("meta"),
        F.struct(F.array(F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_acctbal").alias("balance")).alias("money"), F.array(F.lit(1), F.lit(2)).alias("marks"))).alias("items")).alias("data"),
    )
    return t.customer.select("c_custkey", F.to_json(body).alias("payload"))


@query("nested_flatten_records", """SELECT c_custkey, c_nationkey AS nation, c_acctbal AS "money.balance", '[1,2]' AS marks FROM customer""")
def nested_flatten_records(t):
    """The first array of objects inside each payload, flattened to dotted columns."""
    return N.api_rows(payloads(t), "payload", keep=("c_custkey",)).withColumn("money.balance", F.col("`money.balance`").cast("double"))


@query("nested_flatten_struct", """SELECT c_custkey AS "meta.id", c_mktsegment AS "meta.tags.segment" FROM customer""")
def nested_flatten_struct(t):
    d = N.parse_json_column(payloads(t), "payload").select("json.meta")
    return N.flatten(d)


def messages(t):
    """Payloads of every kind, one per event."""
    k = F.col("event_id")
    obj = F.to_json(F.struct(k.alias("id"), F.col("value").cast("decimal(12,2)").alias("v")))
    body = (
        F.when(k % 6 == 0, obj).when(k % 6 == 1, F.concat(F.lit("["), obj, F.lit(","), obj, F.lit(",5]"))).when(k % 6 == 2, F.concat(obj, F.lit("\n"), obj, F.lit("\nnot json")))
        .when(k % 6 == 3, F.concat(k.cast("string"), F.lit(',"a, b",'), F.col("event_type"))).when(k % 6 == 4, F.lit('{"id": ')).otherwise(F.lit(""))
    )
    return t.events.select(k.alias("event_id"), F.concat(F.lit("site."), F.col("event_type"), F.lit(".u"), F.col("user_id").cast("string")).alias("subject"), body.cast("binary").alias("value"))


@query(
    "parse_messages",
    """WITH m AS (SELECT event_id % 6 AS r, count(*) AS n FROM events GROUP BY 1)
       SELECT CASE r WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'ndjson' WHEN 3 THEN 'csv' WHEN 4 THEN 'json' ELSE 'binary' END AS format,
              sum(n * CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS records, sum(n * CASE r WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS errors FROM m GROUP BY 1""",
)
def parse_messages(t):
    p = M.parse_messages(messages(t), keys=["event_id"])
    return p.groupBy("format").agg(F.count("record").alias("records"), F.count("error").alias("errors"))


@query("parse_messages_csv_cells", """SELECT event_id, CAST(event_id AS VARCHAR) AS id, 'a, b' AS label, event_type AS kind FROM events WHERE event_id % 6 = 3""")
def parse_messages_csv_cells(t):
    p = M.parse_messages(messages(t), keys=["event_id"], headers=["id", "label", "kind"]).where("format = 'csv'")
    m = F.from_json("record", "id string, label string, kind string")
    return p.select("event_id", m["id"].alias("id"), m["label"].alias("label"), m["kind"].alias("kind"))


@query(
    "infer_message_schema",
    """SELECT 'id' AS name, 'INTEGER' AS type, CAST(0 AS BIGINT) AS null_count FROM events UNION SELECT 'v', 'DOUBLE', CAST(0 AS BIGINT) FROM events UNION SELECT 'at', 'TIMESTAMP', CAST(0 AS BIGINT) FROM events
       UNION SELECT 'ok', 'BOOLEAN', (SELECT count(*) FROM events WHERE event_id % 4 = 0) FROM events UNION SELECT 'kind', 'VARCHAR', CAST(0 AS BIGINT) FROM events""",
)
def infer_message_schema(t):
    k = F.col("event_id")
    body = F.struct(
        k.alias("id"), F.when(k % 2 == 0, F.col("value").cast("decimal(12,2)").cast("string")).otherwise(k.cast("string")).alias("v"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.when(k % 4 != 0, k % 2 == 0).alias("ok"), F.col("event_type").alias("kind"),
    )
    return M.infer_record_schema(t.events.select(F.to_json(body).alias("record")))


@query("subject_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'purchase' OR user_id = 3 GROUP BY 1")
def subject_filter(t):
    m = messages(t)
    hit = M.subject_matches(F.col("subject"), "site.purchase.>") | M.subject_matches(F.col("subject"), "site.*.u3")
    return m.where(hit).groupBy(F.split("subject", r"\.")[1].alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "webhook_batch",
    """SELECT count(*) AS "rows", count(*) FILTER (WHERE q.quality IS NULL) AS missing_required, CAST((SELECT count(*) - count(DISTINCT lang) FROM documents) AS BIGINT) AS repeated_keys, 'warn' AS status FROM documents d LEFT JOIN labels q USING (doc_id)""",
)
def webhook_batch(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return M.batch_report(d, ["doc_id", "quality"], "lang").drop("digest")


@query(
    "changed_files",
    """SELECT 'p' || CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 5 = 0 THEN 'new' ELSE 'changed' END AS change FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0""",
)
def changed_files(t):
    k = F.col("page_id")
    path = F.concat(F.lit("p"), k).alias("path")
    old = t.pages.where(k % 5 != 0).select(path, F.length("html").alias("size"), F.lit(1).alias("modified"))
    new = t.pages.select(path, F.length("html").alias("size"), F.when(k % 7 == 0, 2).otherwise(1).alias("modified"))
    return S.changed_files(new, old)


def bundles(t):
    """One health-record bundle per order: patient, encounter, observation, condition."""
    k = F.col("o_orderkey")
    born = F.concat((1930 + F.col("o_custkey") % 70).cast("string"), F.lit("-01-01"))
    when = F.date_format("o_orderdate", "yyyy-MM-dd")
    txt = F.format_string(
        '{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"p%d","gender":"female","birthDate":"%s"}},{"resource":{"resourceType":"Encounter","id":"e%d","subject":{"reference":"Patient/p%d"},"class":{"code":"AMB"},"period":{"start":"%s"},"age":%d}},{"resource":{"resourceType":"Observation","id":"o%d","subject":{"reference":"Patient/p%d"},"code":{"text":"SpO2"},"valueQuantity":{"value":%d,"unit":"%%"}}},{"resource":{"resourceType":"Condition","id":"c%d","subject":{"reference":"urn:uuid:p%d"},"code":{"coding":[{"code":"E11","display":"Diabetes"}]},"onsetDateTime":"%s"}},{"resource":{"resourceType":"Device","id":"d"}}]}',
        k, born, k, k, when, F.when(k % 9 == 0, 5).otherwise(F.year("o_orderdate") - (1930 + F.col("o_custkey") % 70)), k, k, F.when(k % 8 == 0, 140).otherwise(97), k, k, when,
    )
    return t.orders.select(txt.alias("body"))


@query(
    "bundle_tables",
    """SELECT 'Patient' AS resource, count(*) AS n, count(*) AS linked FROM orders UNION ALL SELECT 'Condition', count(*), count(*) FROM orders UNION ALL SELECT 'Observation', count(*), count(*) FROM orders UNION ALL SELECT 'Encounter', count(*), count(*) FROM orders""",
)
def bundle_tables(t):
    tabs = N.bundle_tables(bundles(t), "body")
    out = None
    for name, d in tabs.items():
        link = F.col("id") if name == "Patient" else F.when(F.col("patient").startswith("p"), F.col("patient"))
        row = d.agg(F.lit(name).alias("resource"), F.count(F.lit(1)).alias("n"), F.count(link).alias("linked"))
        out = row if out is None else out.unionByName(row)
    return out


@query("bundle_observation_limits", "SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, 'spo2' AS vital, CAST(140 AS DOUBLE) AS value FROM orders WHERE o_orderkey % 8 = 0")
def bundle_observation_limits(t):
    return N.observation_limits(N.bundle_tables(bundles(t), "body")["Observation"]).select("id", "vital", "value")


@query(
    "bundle_age_consistency",
    """WITH d AS (SELECT o_orderkey AS k, year(o_orderdate) - (1930 + o_custkey % 70) AS actual FROM orders) SELECT 'e' || CAST(k AS VARCHAR) AS id, 5 AS age, actual AS actual_age FROM d WHERE k % 9 = 0 AND abs(5 - actual) > 1""",
)
def bundle_age_consistency(t):
    tabs = N.bundle_tables(bundles(t), "body")
    a = L.age_consistency(tabs["Encounter"], tabs["Patient"])
    return a.select("id", F.col("age").cast("int").alias("age"), F.col("actual_age").cast("int").alias("actual_age"))


@query(
    "page_coverage",
    r"""WITH x AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages)
        SELECT count(*) AS pages, count(*) FILTER (WHERE text <> '') AS with_text, count(*) FILTER (WHERE text = '') AS without_text, CAST(sum(length(text)) AS BIGINT) AS characters, CASE WHEN count(*) FILTER (WHERE text = '') > 0 THEN 'warn' ELSE 'pass' END AS status FROM x""",
)
def page_coverage(t):
    return D.page_coverage(D.page_rows(t.pages.withColumn("text", D.html_text(F.col("html"))), "page_id", "text"))


@query(
    "transcript_rows",
    r"""WITH c AS (SELECT conv_id, turn, turn * 30.0 AS s, turn * 30.0 + length(text) / 15.0 AS e, trim(text) AS t FROM conversations)
        SELECT conv_id, turn, round(e - s, 4) AS duration_sec, CAST(length(t) AS BIGINT) AS char_count, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END AS word_count FROM c""",
)
def transcript_rows(t):
    d = t.conversations.withColumns({"s": F.col("turn") * 30.0, "e": F.col("turn") * 30.0 + F.length("text") / 15.0})
    r = D.transcript_rows(d, "s", "e", "text", ("conv_id", "turn"))
    return r.select("conv_id", "turn", F.round("duration_sec", 4).alias("duration_sec"), "char_count", "word_count")


@query("transcript_summary")
def transcript_summary(t):
    d = t.conversations.withColumns({"s": F.col("turn") * 30.0, "e": F.col("turn") * 30.0 + F.length("text") / 15.0})
    return D.transcript_summary(D.transcript_rows(d, "s", "e", "text"))


@query("warehouse_type_map", "SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey % 2 = 0 AS even FROM orders")
def warehouse_type_map(t):
    raw = t.orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 2 == 0).cast("string").alias("even"))
    d = W.apply_type_map(raw, {"o_orderkey": "INT64", "o_totalprice": "NUMERIC", "day": "DATE", "even": "BOOL"})
    return d.withColumn("day", F.col("day").cast("string"))


@query("database_slice_bounds", "SELECT min(l_orderkey) AS lower, max(l_orderkey) AS upper, 16 AS parts FROM lineitem")
def database_slice_bounds(t):
    return W.partition_bounds(t.lineitem, "l_orderkey", 16)


@query(
    "stats_export",
    """SELECT 'c_nationkey' AS "column", 'number' AS kind, count(*) AS "rows", count(DISTINCT c_nationkey) AS distinct_values FROM customer UNION ALL SELECT 'c_mktsegment', 'text', count(*), count(DISTINCT c_mktsegment) FROM customer""",
)
def stats_export(t):
    return S.stats_export(t.customer.select("c_nationkey", "c_mktsegment")).select("column", "kind", "rows", "distinct_values")


@query("csv_round_trip", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def csv_round_trip(t):
    """Write the table as CSV files into a run folder and read it back."""
    from plumbline.session import run_folder

    path = run_folder(t.spark, "csv")
    S.write_csv(t.customer, path)
    good, _ = S.load_csv(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return good.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
