"""Aggregates, pivots, formulas, metrics and chart feeds on the shared tables."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.model import Dataset
from plumbline.operators import aggregates as A
from plumbline.operators import projection as P


def r(c, n=4):
    return F.round(c, n).alias(c)


def cents(c):
    """A money column as an exact decimal, whose mean has six exact digits in any order."""
    return F.col(c).cast("decimal(14,2)").alias(c)


def mean_sql(c):
    """SQL of that mean: whole cents, rounded half up at the sixth digit."""
    s = f"sum(CAST(round({c} * 100) AS HUGEINT))"
    return f"CAST(CAST(({s} * 20000 + count({c})) // (2 * count({c})) AS BIGINT) / 1000000.0 AS DOUBLE)"


@query(
    "select_where_builder",
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem
       WHERE l_shipdate < TIMESTAMP '1999-01-01' AND l_discount >= 0.05 GROUP BY 1 ORDER BY 1 LIMIT 10""",
)
def select_where_builder(t):
    return P.select_where(
        t.lineitem,
        where=[F.col("l_shipdate") < F.lit(dt.datetime(1999, 1, 1)).cast("timestamp_ntz"), F.col("l_discount") >= 0.05],
        group_by=["l_returnflag"],
        aggregates=[F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n")],
        order_by=[F.asc("l_returnflag")],
        limit=10,
    )


@query(
    "filter_conjunction_in_list",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
       WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice > 5000 AND o_custkey > 3 GROUP BY 1, 2""",
)
def filter_conjunction_in_list(t):
    both = P.conjunction(F.col("o_totalprice") > 5000, F.col("o_custkey") > 3)
    kept = P.filter_in(t.orders.where(both), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "5-LOW"]})
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rename_clean_names",
    """SELECT o_orderpriority AS "O Orderpriority", count(*) AS n FROM orders GROUP BY 1""",
)
def rename_clean_names(t):
    return P.rename(t.orders).groupBy("O Orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_cast_text",
    """WITH x AS (SELECT trim(regexp_replace(o_orderpriority, '-.*', '') || CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END) AS raw FROM orders),
            y AS (SELECT raw, TRY_CAST(nullif(regexp_extract(raw, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?', 0), '') AS DOUBLE) AS v FROM x)
       SELECT v AS number_value, CASE WHEN v IS NULL AND raw <> '' THEN raw END AS raw_value, count(*) AS n FROM y GROUP BY 1, 2""",
)
def safe_cast_text(t):
    tag = F.concat(F.regexp_replace("o_orderpriority", "-.*", ""), F.when(F.col("o_orderstatus") == "P", "x").otherwise(""))
    d = P.safe_cast(t.orders.select(tag.alias("c")), "c", "number")
    return d.groupBy(F.col("c").alias("number_value"), F.col("c_raw").alias("raw_value")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "calculated_column",
    """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY 1""",
)
def calculated_column(t):
    d = P.calculated(t.lineitem, "charge", "{l_extendedprice} * (1 - {l_discount}) * (1 + {l_tax})")
    return d.groupBy("l_returnflag").agg(F.round(F.sum("charge"), 2).alias("charge"))


@query(
    "metric_references_sql",
    "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n FROM orders GROUP BY 1",
)
def metric_references_sql(t):
    text = "SELECT o_orderstatus, round(@mean_price, 4) AS mean_price, @n AS n FROM orders GROUP BY o_orderstatus"
    return P.sql({"orders": t.orders}, text, {"mean_price": "avg(o_totalprice)", "n": "count(*)"})


@query("metric_scalar", "SELECT round(sum(l_extendedprice * l_discount), 2) AS value FROM lineitem")
def metric_scalar(t):
    return P.metric_value(t.lineitem, "round(sum(l_extendedprice * l_discount), 2)")


# The masking patterns, in the SQL engine's spelling.
_RX = {
    "ssn": ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    "mrn": ("MRN", r"(?i)\b(?:mrn|medical\s+record(?:\s+(?:no|number|#))?)\s*[:#]?\s*[A-Z]?\d{5,}\b"),
    "email": ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "longdigits": ("ID", r"\b\d{9,}\b"),
}


def _nested(column, upto):
    expr = column
    for name, (label, rx) in _RX.items():
        if name == upto:
            break
        expr = f"regexp_replace({expr}, '{rx}', '[REDACTED:{label}]', 'g')"
    return expr


def _count_sql(table, column):
    return " UNION ALL ".join(
        f"""SELECT '{column}' AS "column", '{n}' AS pattern, CAST(sum(len(regexp_extract_all({_nested(column, n)}, '{rx}'))) AS BIGINT) AS hits FROM {table}"""
        for n, (_, rx) in _RX.items()
    )


@query("redaction_counts_documents", _count_sql("documents", "text"))
def redaction_counts_documents(t):
    return P.redaction_counts(t.documents, ["text"])


@query(
    "redact_conversations",
    f"SELECT conv_id, turn, role, md5({_nested('text', None)}) AS digest FROM conversations",
)
def redact_conversations(t):
    return P.redact(t.conversations).select("conv_id", "turn", P.redacted(F.col("role")).alias("role"), F.md5("text").alias("digest"))


@query(
    "group_aggregate_blank_keys",
    """SELECT CASE WHEN trim(k) = '' OR k IS NULL THEN '(blank)' ELSE trim(k) END AS key, round(sum(v), 2) AS value, count(*) AS "rows"
       FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS k, o_totalprice AS v FROM orders) GROUP BY 1""",
)
def group_aggregate_blank_keys(t):
    k = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus"))
    return A.group_aggregate(t.orders.withColumn("k", k), "k", "o_totalprice", "sum").withColumn("value", F.round("value", 2))


@query(
    "crosstab_cube",
    """SELECT l_returnflag AS row_key, l_linestatus AS column_key, round(avg(l_quantity), 4) AS value, count(*) AS "rows",
       CASE grouping(l_returnflag) * 2 + grouping(l_linestatus) WHEN 0 THEN 'cell' WHEN 1 THEN 'row_total' WHEN 2 THEN 'column_total' ELSE 'grand_total' END AS level
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def crosstab_cube(t):
    return A.crosstab(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", "avg").withColumn("value", F.round("value", 4))


@query(
    "pivot_guarded",
    """SELECT o_orderstatus, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 3) AS "1-URGENT",
       round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 3) AS "2-HIGH", round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM'), 3) AS "3-MEDIUM",
       round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED'), 3) AS "4-NOT SPECIFIED", round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 3) AS "5-LOW"
       FROM orders GROUP BY 1""",
)
def pivot_guarded(t):
    p = A.pivot(t.orders, ["o_orderstatus"], "o_orderpriority", "o_totalprice", "avg")
    return p.select("o_orderstatus", *[F.round(F.col(f"`{c}`"), 3).alias(c) for c in p.columns[1:]])


_FORMULAS = {
    "f_sum": ("SUM", {}, "round(sum(l_quantity), 2)"),
    "f_average": ("AVERAGE", {}, "round(avg(l_quantity), 6)"),
    "f_count": ("COUNT", {}, "count(l_quantity)"),
    "f_counta": ("COUNTA", {}, "count(l_quantity)"),
    "f_countblank": ("COUNTBLANK", {}, "count(*) FILTER (WHERE l_quantity IS NULL)"),
    "f_countif": ("COUNTIF", {"op": ">", "operand": 25}, "count(*) FILTER (WHERE l_quantity > 25)"),
    "f_sumif": ("SUMIF", {"op": "<=", "operand": 10}, "round(sum(l_quantity) FILTER (WHERE l_quantity <= 10), 2)"),
    "f_sumif_range": ("SUMIF", {"op": "=", "operand": 5, "over": "l_extendedprice"}, "round(sum(l_extendedprice) FILTER (WHERE l_quantity = 5), 2)"),
    "f_averageif": ("AVERAGEIF", {"op": "<>", "operand": 1}, "round(avg(l_quantity) FILTER (WHERE l_quantity <> 1), 6)"),
    "f_max": ("MAX", {}, "max(l_quantity)"),
    "f_min": ("MIN", {}, "min(l_quantity)"),
    "f_stdev": ("STDEV", {}, "round(stddev(l_quantity), 6)"),
    "f_stdevp": ("STDEVP", {}, "round(stddev_pop(l_quantity), 6)"),
    "f_var": ("VAR", {}, "round(variance(l_quantity), 6)"),
    "f_varp": ("VARP", {}, "round(var_pop(l_quantity), 6)"),
    "f_median": ("MEDIAN", {}, "median(l_quantity)"),
    "f_distinct": ("DISTINCTCOUNT", {}, "count(DISTINCT l_quantity)"),
}


@query(
    "spreadsheet_formulas",
    "SELECT l_returnflag, " + ", ".join(f"{s} AS {n}" for n, (_, _, s) in _FORMULAS.items()) + " FROM lineitem GROUP BY 1",
)
def spreadsheet_formulas(t):
    aggs = []
    for name, (f, kw, sql) in _FORMULAS.items():
        c = A.formula(f, "l_quantity", **kw)
        places = 2 if "2)" in sql[-3:] else 6
        aggs.append((F.round(c, places) if sql.startswith("round") else c).alias(name))
    return t.lineitem.groupBy("l_returnflag").agg(*aggs)


@query(
    "formula_mode_product",
    """WITH m AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2),
            k AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY c DESC, o_orderpriority) AS rn FROM m)
       SELECT o.o_orderstatus, round(ln(product(1 + o.o_totalprice / 1e12)), 6) AS log_product, max(k.o_orderpriority) AS modal
       FROM orders o JOIN k ON k.o_orderstatus = o.o_orderstatus AND rn = 1 GROUP BY 1""",
)
def formula_mode_product(t):
    d = t.orders.withColumn("g", 1 + F.col("o_totalprice") / 1e12)
    return d.groupBy("o_orderstatus").agg(
        F.round(F.ln(A.formula("PRODUCT", "g")), 6).alias("log_product"), A.formula("MODE", "o_orderpriority").alias("modal")
    )


@query(
    "formula_round_range",
    "SELECT o_orderpriority, round(round(avg(o_totalprice), 1) - round(min(o_totalprice), 1), 1) AS spread FROM orders GROUP BY 1",
)
def formula_round_range(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(F.round(A.formula("AVERAGE", "o_totalprice"), 1) - F.round(A.formula("MIN", "o_totalprice"), 1), 1).alias("spread")
    )


@query(
    "duplicate_rows",
    """WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)
       SELECT CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1), 0) AS BIGINT) AS extra_rows, count(*) FILTER (WHERE c > 1) AS duplicate_groups FROM g""",
)
def duplicate_rows(t):
    return A.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "business_key_duplicates",
    """WITH g AS (SELECT count(*) AS c, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT count(*) FILTER (WHERE c > 1 AND d > 1) AS key_groups, CAST(coalesce(sum(c - 1) FILTER (WHERE c > 1 AND d > 1), 0) AS BIGINT) AS extra_rows FROM g""",
)
def business_key_duplicates(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return A.business_key_duplicates(d, ["l_orderkey", "l_linenumber"])


@query(
    "distinct_counts_exact",
    """SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS distinct_values FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
       UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) FROM lineitem""",
)
def distinct_counts_exact(t):
    return A.distinct_counts(t.lineitem, ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])


@query("distinct_counts_sketch")
def distinct_counts_sketch(t):
    return A.distinct_counts(t.lineitem, ["l_partkey", "l_suppkey", "l_orderkey"], approximate=True)


@query(
    "two_path_agreement",
    "SELECT count(DISTINCT l_shipdate) AS groups, CAST(0 AS BIGINT) AS mismatches, 'pass' AS status FROM lineitem",
)
def two_path_agreement(t):
    return A.two_path_agreement(t.lineitem, "l_shipdate", "l_extendedprice")


@query(
    "quality_signals",
    """WITH b AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS low, count(*) FILTER (WHERE c_mktsegment IS NULL) + count(*) FILTER (WHERE c_acctbal IS NULL) + count(*) FILTER (WHERE c_nationkey IS NULL) AS nulls FROM customer),
            d AS (SELECT sum(c - 1) AS extra FROM (SELECT count(*) AS c FROM customer GROUP BY c_nationkey, c_acctbal, c_mktsegment))
       SELECT round(nulls / (n * 3), 4) AS missingness_rate, round(low / n, 4) AS out_of_range_rate, round(extra / n, 4) AS duplicate_rate, CAST(36.0 AS DOUBLE) AS freshness_hours FROM b, d""",
)
def quality_signals(t):
    ds = Dataset("customer", t.customer.select("c_nationkey", "c_acctbal", "c_mktsegment"), dt.datetime(2024, 1, 1))
    return A.quality_signals(ds, F.lit(dt.datetime(2024, 1, 2, 12)), ["c_acctbal"])


@query(
    "entity_baseline_part",
    f"SELECT l_partkey, {mean_sql('l_extendedprice')} AS mean, round(stddev_pop(l_extendedprice), 4) AS sigma, count(l_extendedprice) AS n FROM lineitem GROUP BY 1",
)
def entity_baseline_part(t):
    lines = t.lineitem.select("l_partkey", cents("l_extendedprice"))
    return A.entity_baseline(lines, ["l_partkey"], "l_extendedprice").select("l_partkey", F.col("mean").cast("double"), r("sigma"), "n")


@query(
    "metric_library",
    """SELECT c_mktsegment, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 2) AS denial_rate_pct,
       round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER))), 2) AS avg_length_of_stay_days,
       round(avg(o_totalprice / 1e5), 4) AS case_mix_index, round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 100.0 / count(*), 2) AS readmission_rate_30d_pct,
       round(count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderkey % 11 = 1) * 100.0 / count(*), 2) AS mortality_rate_pct,
       round(count(*) FILTER (WHERE o_orderpriority = '2-HIGH' OR o_orderkey % 5 = 1) * 100.0 / count(*), 2) AS ed_utilization_rate_pct,
       round(sum(c_acctbal) * 100.0 / sum(o_totalprice), 2) AS net_payment_rate_pct, round(count(*) FILTER (WHERE c_acctbal IS NULL) * 100.0 / count(*), 2) AS null_rate_pct,
       count(*) AS row_count, count(DISTINCT c_custkey) AS distinct_count
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def metric_library(t):
    key = F.col("o_orderkey")
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_mktsegment", "c_acctbal", "c_custkey",
        F.when(F.col("o_orderstatus") == "F", "DENIED").otherwise("PAID").alias("claim_status"),
        F.col("o_orderdate").cast("date").alias("admit_date"),
        F.date_add(F.col("o_orderdate").cast("date"), (key % 9).cast("int")).alias("discharge_date"),
        (F.col("o_totalprice") / 1e5).alias("drg_weight"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("readmit_30d"),
        F.when(F.col("o_orderstatus") == "P", "EXPIRED").otherwise("HOME").alias("discharge_disposition"),
        (key % 11 == 1).cast("int").alias("deceased"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "EMERGENCY").otherwise("CLINIC").alias("admit_source"),
        (key % 5 == 1).cast("int").alias("emergency_admit"),
        F.col("c_acctbal").alias("payment_amount"), F.col("o_totalprice").alias("billed_amount"),
    )
    metrics = [*A.METRICS.values(), A.null_rate_metric("c_acctbal"), A.distinct_count_metric("c_custkey")]
    return A.evaluate_metrics(d, metrics, ["c_mktsegment"])


@query(
    "top_groups",
    'SELECT l_suppkey AS key, round(sum(l_extendedprice), 2) AS value, count(*) AS "rows" FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 10',
)
def top_groups(t):
    return A.top_groups(t.lineitem, "l_suppkey", "l_extendedprice", "sum", 10).withColumn("value", F.round("value", 2))


@query(
    "bottom_groups",
    'SELECT p_brand AS key, round(avg(p_retailprice), 4) AS value, count(*) AS "rows" FROM part GROUP BY 1 ORDER BY avg(p_retailprice), 1 LIMIT 5',
)
def bottom_groups(t):
    return A.top_groups(t.part, "p_brand", "p_retailprice", "avg", 5, bottom=True).withColumn("value", F.round("value", 4))


@query(
    "distribution_shares",
    'SELECT c_mktsegment AS key, count(*) AS "rows", round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1',
)
def distribution_shares(t):
    return A.distribution(t.customer, "c_mktsegment").withColumn("share", F.round("share", 6))


@query(
    "missing_by_column",
    """SELECT 'doc_id' AS "column", count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) AS "rows" FROM documents d LEFT JOIN labels l USING (doc_id)
       UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL), count(*) FROM documents d LEFT JOIN labels l USING (doc_id)
       UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR trim(lang) = ''), count(*) FROM documents""".replace("l.doc_id IS NULL", "d.doc_id IS NULL"),
)
def missing_by_column(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "lang")
    return A.missing_by_column(d)


@query("describe_number", "SELECT count(o_totalprice) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean FROM orders")
def describe_number(t):
    return A.describe_number(t.orders, "o_totalprice").withColumn("mean", F.round("mean", 4))


@query(
    "trend_monthly",
    "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
)
def trend_monthly(t):
    return A.trend(t.orders, "o_orderdate", "o_totalprice").select(F.col("period").cast("string"), F.round("value", 2).alias("value"))


@query(
    "trend_weekly_count",
    "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS period, count(*) AS value FROM events GROUP BY 1",
)
def trend_weekly_count(t):
    return A.trend(t.events, "ts", "value", "count", "week").withColumn("period", F.col("period").cast("string"))


@query("chart_pie", "SELECT event_type AS x, count(*) AS y FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def chart_pie(t):
    return A.pie_feed(t.events, "event_type")


@query("chart_bar", "SELECT CAST(l_suppkey AS VARCHAR) AS x, round(avg(l_quantity), 4) AS y FROM lineitem GROUP BY 1 ORDER BY avg(l_quantity) DESC, 1 LIMIT 25")
def chart_bar(t):
    return A.bar_feed(t.lineitem, "l_suppkey", "l_quantity").withColumn("y", F.round("y", 4))


@query("chart_line", f"SELECT CAST(o_orderdate AS VARCHAR) AS x, {mean_sql('o_totalprice')} AS y FROM orders GROUP BY o_orderdate")
def chart_line(t):
    orders = t.orders.select("o_orderdate", cents("o_totalprice"))
    return A.line_feed(orders, "o_orderdate", "o_totalprice").select(F.date_format("x", "yyyy-MM-dd HH:mm:ss").alias("x"), F.col("y").cast("double").alias("y"))


@query(
    "chart_scatter_sample",
    """SELECT l_quantity AS x, l_extendedprice AS y FROM (SELECT l_quantity, l_extendedprice, l_orderkey || '-' || l_linenumber AS id FROM lineitem)
       ORDER BY md5(id || ':7'), 1, 2 LIMIT 5000""",
)
def chart_scatter_sample(t):
    return A.scatter_feed(t.lineitem.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "l_quantity", "l_extendedprice", "id")


@query(
    "chart_box",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS md, quantile_cont(o_totalprice, 0.75) AS q3, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT 'o_totalprice' AS "column", round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(least(hi, q3 + 1.5 * (q3 - q1)), 4) AS whisker_high FROM q""",
)
def chart_box(t):
    b = A.box_feed(t.orders, "o_totalprice")
    return b.select("column", *[r(c) for c in b.columns[1:]])


@query(
    "chart_histogram",
    """WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL), k AS (SELECT *, least(20, CAST(ceil(sqrt(n)) AS INTEGER)) AS b FROM s)
       SELECT CAST(least(b - 1, floor((value - lo) / ((hi - lo) / b))) AS BIGINT) AS bin, count(*) AS "rows",
              round(max(lo) + CAST(least(b - 1, floor((value - lo) / ((hi - lo) / b))) AS BIGINT) * max((hi - lo) / b), 6) AS bin_low
       FROM events, k WHERE value IS NOT NULL GROUP BY 1, b, lo, hi""",
)
def chart_histogram(t):
    return A.histogram(t.events, "value").withColumn("bin_low", F.round("bin_low", 6))


@query(
    "downsample_series",
    """WITH n AS (SELECT count(*) AS n FROM events WHERE value IS NOT NULL), o AS (SELECT ts, value, event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events WHERE value IS NOT NULL)
       SELECT pos AS position, value AS v FROM o, n WHERE (pos - 1) % greatest(1, n // 60) = 0""",
)
def downsample_series(t):
    return A.downsample(t.events, "ts", "value", "event_id").select("position", "v")


@query(
    "kpi_halves",
    """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER () AS n FROM orders)
       SELECT 'o_totalprice' AS "column", round(sum(v), 2) AS total, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, count(*) AS n,
              round((avg(v) FILTER (WHERE pos > n // 2) - avg(v) FILTER (WHERE pos <= n // 2)) / abs(avg(v) FILTER (WHERE pos <= n // 2)), 6) AS delta,
              CAST(list(v ORDER BY pos) FILTER (WHERE pos > n - 12) AS VARCHAR) AS last12 FROM o""".replace("CAST(list(v ORDER BY pos) FILTER (WHERE pos > n - 12) AS VARCHAR)", "list(v ORDER BY pos) FILTER (WHERE pos > n - 12)"),
)
def kpi_halves(t):
    k = A.kpis(t.orders, "o_totalprice", "o_orderdate", "o_orderkey")
    return k.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4), "delta": F.round("delta", 6)})


@query(
    "auto_charts",
    """SELECT 'mean_by_category' AS chart, o_orderpriority AS x, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY 2
       UNION ALL SELECT 'count_by_category', o_orderpriority, count(*) FROM orders GROUP BY 2
       UNION ALL SELECT 'monthly_mean', CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR), round(avg(o_totalprice), 4) FROM orders GROUP BY 2""",
)
def auto_charts(t):
    return A.auto_charts(t.orders, "o_orderpriority", "o_totalprice", "o_orderdate").withColumn("y", F.round("y", 4))


@query(
    "weighted_vector_mean",
    """WITH e AS (SELECT vec_id, greatest(1.0, label) AS w, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm, embedding FROM embeddings),
            u AS (SELECT w, nrm, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM e)
       SELECT CAST(position AS BIGINT) AS position, round(sum(w * CASE WHEN nrm > 0.9 THEN CAST(x AS DOUBLE) * 0.9 / nrm ELSE x END) / sum(w), 6) AS mean, (SELECT count(*) FROM embeddings) AS cohort FROM u GROUP BY 1""",
)
def weighted_vector_mean(t):
    return A.weighted_vector_mean(t.embeddings, "embedding", "label", clip=0.9, min_cohort=3).withColumn("mean", F.round("mean", 6))


def _vector_draw(draw: int) -> str:
    text = f"vec_id || ':' || position || ':{draw}'"
    return f"((CAST('0x' || substr(sha256('for tests only:' || sha256('for tests only:' || {text})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query(
    "weighted_vector_mean_noised",
    f"""WITH e AS (SELECT vec_id, greatest(1.0, label) AS w, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm, embedding FROM embeddings),
             u AS (SELECT vec_id, w, nrm, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM e),
             c AS (SELECT w, position, CASE WHEN nrm > 1.0 THEN CAST(x AS DOUBLE) * 1.0 / nrm ELSE x END + 0.1 * sqrt(-2 * ln({_vector_draw(1)})) * cos(2 * pi() * {_vector_draw(2)}) AS x FROM u)
        SELECT CAST(position AS BIGINT) AS position, round(sum(w * x) / sum(w), 6) AS mean, (SELECT count(*) FROM embeddings) AS cohort FROM c GROUP BY 1""",
)
def weighted_vector_mean_noised(t):
    m = A.weighted_vector_mean(t.embeddings, "embedding", "label", clip=1.0, min_cohort=3, noise_sigma=0.1, key="vec_id", secret="for tests only")
    return m.withColumn("mean", F.round("mean", 6))


@query(
    "result_claims",
    """WITH s AS (SELECT count(*) AS n, avg(o_totalprice) AS m FROM orders), c AS (SELECT o_orderpriority AS k, count(*) AS c FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
       SELECT 'rowcount' AS kind, NULL AS "column", CAST(n AS DOUBLE) AS value, NULL AS label, n, CAST(0 AS DOUBLE) AS missing_rate, 100 AS score, 'A' AS grade FROM s
       UNION ALL SELECT 'numeric_mean', 'o_totalprice', round(m, 4), NULL, n, 0.0, 100, 'A' FROM s
       UNION ALL SELECT 'category_share', 'o_orderpriority', round(c / n * 100, 1), k, n, 0.0, 100, 'A' FROM s, c""",
)
def result_claims(t):
    return A.result_claims(t.orders, "o_totalprice", "o_orderpriority")


@query(
    "rollup_sets",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def rollup_sets(t):
    return A.grouping_sets(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "qty": F.round(F.sum("l_quantity"), 2)})


@query(
    "set_operations",
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
       UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
       UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""",
)
def set_operations(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "union_all": a.unionByName(b), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, d in parts.items():
        row = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("row_sample_fixed_size", "SELECT least(50000, count(*)) AS rows_taken FROM lineitem")
def row_sample_fixed_size(t):
    """The fixed-size sampling operator: the rows with the smallest hash of their key."""
    h = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", F.lit(11))
    picked = t.lineitem.withColumn("_h", h).orderBy("_h").limit(50_000)
    return picked.agg(F.count(F.lit(1)).alias("rows_taken"))


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").dropDuplicates()
