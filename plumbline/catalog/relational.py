"""Joins and key checks on the star-schema tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import aggregates as A
from plumbline.operators import joins as J
from plumbline.operators import ordered_joins as O


@query(
    "pivot_revenue_checked",
    """
    WITH good AS (
      SELECT l.* FROM lineitem l
      WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
        AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey))
    SELECT l_returnflag,
           round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) END), 2) AS "F",
           round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * (1 - l_discount) END), 2) AS "O"
    FROM good GROUP BY l_returnflag
    """,
)
def pivot_revenue_checked(t):
    """Revenue by return flag and line status over lines whose order and part exist."""
    good = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(
        t.part, F.col("l_partkey") == F.col("p_partkey"), "left_semi"
    )
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = A.pivot(good.withColumn("revenue", revenue), ["l_returnflag"], "l_linestatus", "revenue", "sum", ["F", "O"])
    return out.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query(
    "join_graph_star",
    """
    SELECT n_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1, 2
    """,
)
def join_graph_star(t):
    g = J.join_graph(
        {"orders": t.orders, "customer": t.customer, "nation": t.nation, "region": t.region},
        [
            J.Edge("orders", "customer", "o_custkey", "c_custkey"),
            J.Edge("customer", "nation", "c_nationkey", "n_nationkey"),
            J.Edge("nation", "region", "n_regionkey", "r_regionkey"),
        ],
        where=F.col("r_name") != "ASIA",
    )
    return g.groupBy("n_name", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "join_text_keys_left",
    """
    SELECT c_mktsegment, count(*) AS rows_out, count(o_orderkey) AS matched,
           count(DISTINCT c_custkey) AS customers
    FROM customer LEFT JOIN orders ON CAST(c_custkey AS VARCHAR) = CAST(o_custkey AS VARCHAR) GROUP BY 1
    """,
)
def join_text_keys_left(t):
    j = J.join_tables(t.customer, t.orders, "c_custkey", "o_custkey", "left")
    return j.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.count("o_orderkey").alias("matched"),
        F.count_distinct("c_custkey").alias("customers"),
    )


@query(
    "join_text_keys_full",
    """
    SELECT count(*) AS rows_out, count(ps.p_partkey) AS left_rows, count(l.l_orderkey) AS right_rows
    FROM part ps FULL JOIN lineitem l ON CAST(ps.p_partkey AS VARCHAR) = CAST(l.l_suppkey AS VARCHAR)
    """,
)
def join_text_keys_full(t):
    left = t.part.withColumn("in_left", F.lit(1))
    j = J.join_tables(left, t.lineitem, "p_partkey", "l_suppkey", "full")
    return j.agg(
        F.count(F.lit(1)).alias("rows_out"), F.count("in_left").alias("left_rows"), F.count("l_orderkey").alias("right_rows")
    )


@query(
    "join_key_overlap",
    """
    WITH a AS (UNPIVOT (SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation)
               ON n_nationkey, n_name, n_regionkey INTO NAME left_column VALUE v),
         b AS (UNPIVOT (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
                               CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer)
               ON c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment INTO NAME right_column VALUE v),
         da AS (SELECT DISTINCT left_column, v FROM a), db AS (SELECT DISTINCT right_column, v FROM b),
         na AS (SELECT left_column, count(*) AS na FROM da GROUP BY 1), nb AS (SELECT right_column, count(*) AS nb FROM db GROUP BY 1),
         s AS (SELECT left_column, right_column, count(*) AS shared FROM da JOIN db USING (v) GROUP BY 1, 2)
    SELECT left_column, right_column, shared, round(shared / greatest(na, nb), 6) AS overlap
    FROM s JOIN na USING (left_column) JOIN nb USING (right_column) WHERE shared / greatest(na, nb) > 0.3
    """,
)
def join_key_overlap(t):
    return J.value_overlap(t.nation, t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)")))


@query(
    "relationship_report",
    """
    WITH c AS (
      SELECT 'orders' AS from_table, 'o_custkey' AS from_column, 'customer' AS to_table, 'c_custkey' AS to_column,
             avg(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0 END) AS cov FROM orders
      UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', 'o_orderkey',
             avg(CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN 1.0 ELSE 0 END) FROM lineitem
      UNION ALL SELECT 'lineitem', 'l_partkey', 'part', 'p_partkey',
             avg(CASE WHEN l_partkey IN (SELECT p_partkey FROM part) THEN 1.0 ELSE 0 END) FROM lineitem
      UNION ALL SELECT 'lineitem', 'l_suppkey', 'supplier', 's_suppkey',
             avg(CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier) THEN 1.0 ELSE 0 END) FROM lineitem)
    SELECT from_table, from_column, to_table, to_column,
           CASE WHEN cov >= 1 THEN 'certain' ELSE 'inferred' END AS certainty, round(cov, 6) AS child_coverage FROM c
    """,
)
def relationship_report(t):
    tables = {"lineitem": t.lineitem, "orders": t.orders, "customer": t.customer, "part": t.part, "supplier": t.supplier}
    return J.relationship_report(tables)


@query(
    "join_cardinality",
    """
    WITH a AS (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
         b AS (SELECT c_custkey AS k, count(*) AS b FROM customer WHERE c_custkey IS NOT NULL GROUP BY 1)
    SELECT count(a) AS left_unique, count(b) AS right_unique,
           CAST(sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched_keys,
           CAST(sum(CASE WHEN a IS NOT NULL THEN b ELSE 0 END) AS BIGINT) AS estimate_one_per_left_key,
           CAST(sum(a * b) AS BIGINT) AS output_rows,
           (SELECT count(*) FROM orders) AS left_total, (SELECT count(*) FROM customer) AS right_total,
           'N:1' AS shape,
           round(sum(CASE WHEN a IS NOT NULL THEN b ELSE 0 END) / (SELECT count(*) FROM orders), 6) AS fan_out,
           'safe' AS severity
    FROM a FULL JOIN b USING (k)
    """,
)
def join_cardinality(t):
    return J.join_cardinality(t.orders, "o_custkey", t.customer, "c_custkey")


def _fk_sql(child, ck, parent, pk):
    return f"""
    WITH o AS (SELECT {ck} AS k FROM {child} WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {parent} WHERE {pk} IS NOT NULL)),
         n AS (SELECT count(*) AS total, (SELECT count(*) FROM o) AS orphans FROM {child} WHERE {ck} IS NOT NULL)
    SELECT '{ck}->{pk}' AS relation, total AS total_rows, orphans AS orphan_count,
           (SELECT count(DISTINCT k) FROM o) AS orphan_keys,
           (SELECT count(*) FROM {child} WHERE {ck} IS NULL) AS null_count,
           round(orphans / total, 6) AS orphan_rate,
           CASE WHEN orphans / total >= 0.01 THEN 'fail' WHEN orphans / total >= 0.001 THEN 'warn' ELSE 'pass' END AS status,
           coalesce((SELECT list(k ORDER BY k) FROM (SELECT DISTINCT CAST(k AS VARCHAR) AS k FROM o ORDER BY 1 LIMIT 5)), []) AS orphan_sample
    FROM n
    """


@query("foreign_key_lines_part", _fk_sql("lineitem", "l_partkey", "part", "p_partkey"))
def foreign_key_lines_part(t):
    return J.check_foreign_key(t.lineitem, "l_partkey", t.part, "p_partkey")


@query("foreign_key_documents_labels", _fk_sql("documents", "doc_id", "labels", "doc_id"))
def foreign_key_documents_labels(t):
    return J.check_foreign_key(t.documents, "doc_id", t.labels, "doc_id")


@query(
    "orphan_check_text_keys",
    """
    SELECT 'orders.o_custkey' AS relation, count(*) AS total_rows,
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels r WHERE CAST(r.doc_id AS VARCHAR) = CAST(o_custkey AS VARCHAR))) AS orphan_count
    FROM orders WHERE o_custkey IS NOT NULL
    """,
)
def orphan_check_text_keys(t):
    """Reference check with keys compared as text, here against ids that only partly exist."""
    out = J.check_foreign_key(t.orders, "o_custkey", t.labels, "doc_id", "orders.o_custkey", as_text=True)
    return out.select("relation", "total_rows", "orphan_count")


@query(
    "join_coverage",
    """
    WITH c AS (SELECT count(*) AS child_total,
                      count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS child_matched,
                      count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS parent_matched,
                      (SELECT count(*) FROM labels) AS parent_total FROM documents)
    SELECT 'documents->labels' AS relation, *, round(child_matched / child_total, 6) AS child_coverage,
           round(parent_matched / parent_total, 6) AS parent_coverage,
           CASE WHEN child_matched / child_total < 0.9 THEN 'fail' WHEN child_matched / child_total < 0.95 THEN 'warn' ELSE 'pass' END AS status
    FROM c
    """,
)
def join_coverage(t):
    return J.check_join_coverage(t.documents, "doc_id", t.labels, "doc_id", "documents->labels")


PAIRS_SQL = "(SELECT p_partkey AS a, p_partkey + 1 AS b FROM part)"


@query(
    "code_conflicts_same_order",
    f"""
    WITH rules AS (SELECT DISTINCT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS code_a,
                          greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS code_b FROM {PAIRS_SQL})
    SELECT r.code_a, r.code_b, count(DISTINCT x.l_orderkey) AS entities, count(*) AS row_pairs
    FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey
    JOIN rules r ON CAST(x.l_partkey AS VARCHAR) = r.code_a AND CAST(y.l_partkey AS VARCHAR) = r.code_b GROUP BY 1, 2
    """,
)
def code_conflicts_same_order(t):
    """Forbidden part pairs in one order; the rule table is derived from the part table."""
    rules = t.part.select(F.col("p_partkey").alias("code_a"), (F.col("p_partkey") + 1).alias("code_b"))
    return J.conflict_pairs(t.lineitem, ["l_orderkey"], "l_partkey", rules)


@query(
    "code_conflict_findings",
    f"""
    WITH rules AS (SELECT DISTINCT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS code_a,
                          greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS code_b FROM {PAIRS_SQL}),
    hits AS (SELECT r.code_a, r.code_b, count(DISTINCT x.l_orderkey) AS entities, count(*) AS row_pairs
             FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey
             JOIN rules r ON CAST(x.l_partkey AS VARCHAR) = r.code_a AND CAST(y.l_partkey AS VARCHAR) = r.code_b GROUP BY 1, 2)
    SELECT 'code_conflict' AS layer, code_a || '+' || code_b AS rule, 'fail' AS status, 'hard' AS severity, entities AS count,
           round(entities / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 9) AS rate, row_pairs || ' pairs of rows' AS detail FROM hits
    """,
)
def code_conflict_findings(t):
    """The same conflicts as a validation layer gives them."""
    rules = t.part.select(F.col("p_partkey").alias("code_a"), (F.col("p_partkey") + 1).alias("code_b"))
    return J.conflict_findings(t.lineitem, ["l_orderkey"], "l_partkey", rules).drop("columns").withColumn("rate", F.round("rate", 9))


@query(
    "near_duplicate_orders",
    """
    WITH d AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS "rows" FROM orders GROUP BY 1, 2, 3),
         g AS (SELECT *, date_diff('day', lag(day) OVER w, day) AS p, date_diff('day', day, lead(day) OVER w) AS n
               FROM d WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY day))
    SELECT o_custkey, o_orderpriority, CAST(day AS VARCHAR) AS day, "rows",
           least(coalesce(p, n), coalesce(n, p)) AS nearest_gap
    FROM g WHERE least(coalesce(p, n), coalesce(n, p)) <= 3
    """,
)
def near_duplicate_orders(t):
    return J.near_duplicates(t.orders, ["o_custkey", "o_orderpriority"], "o_orderdate", 3).withColumn(
        "day", F.col("day").cast("string")
    )


@query(
    "lifespan_violations",
    """
    WITH p AS (SELECT c_custkey AS k, DATE '1995-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS born,
                      DATE '2001-01-01' + CAST(c_custkey % 300 AS INTEGER) AS died FROM customer)
    SELECT count(*) AS checked, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < born) AS before_birth,
           count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > died) AS after_death
    FROM orders JOIN p ON o_custkey = k
    """,
)
def lifespan_violations(t):
    """Orders outside a customer's (derived) active span."""
    people = t.customer.select(
        "c_custkey",
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("born"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("died"),
    )
    return J.lifespan_violations(t.orders, "o_custkey", "o_orderdate", people, "c_custkey", "born", "died")


VERSION_B = """(SELECT o_orderkey + 10 AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                o_orderpriority FROM orders)"""


def _order_versions(t):
    a = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    b = t.orders.select((F.col("o_orderkey") + 10).alias("o_orderkey"), "o_custkey", status.alias("o_orderstatus"), "o_orderpriority")
    return a, b


@query(
    "keyed_row_diff",
    f"""
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), b AS {VERSION_B},
         j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key, a.o_orderkey IS NULL AS na, b.o_orderkey IS NULL AS nb,
                      CAST(a.o_custkey AS VARCHAR) AS a1, CAST(b.o_custkey AS VARCHAR) AS b1, a.o_orderstatus AS a2, b.o_orderstatus AS b2,
                      a.o_orderpriority AS a3, b.o_orderpriority AS b3 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
    SELECT key, 'added' AS change, NULL AS "column", NULL AS "from", NULL AS "to" FROM j WHERE na
    UNION ALL SELECT key, 'removed', NULL, NULL, NULL FROM j WHERE nb
    UNION ALL SELECT key, 'changed', 'o_custkey', a1, b1 FROM j WHERE NOT na AND NOT nb AND a1 IS DISTINCT FROM b1
    UNION ALL SELECT key, 'changed', 'o_orderstatus', a2, b2 FROM j WHERE NOT na AND NOT nb AND a2 IS DISTINCT FROM b2
    UNION ALL SELECT key, 'changed', 'o_orderpriority', a3, b3 FROM j WHERE NOT na AND NOT nb AND a3 IS DISTINCT FROM b3
    """,
)
def keyed_row_diff(t):
    return J.keyed_diff(*_order_versions(t), "o_orderkey")


@query(
    "keyed_diff_summary",
    f"""
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), b AS {VERSION_B}
    SELECT count(*) FILTER (WHERE a.o_orderkey IS NULL) AS added, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS removed,
           count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND
              (a.o_custkey, a.o_orderstatus, a.o_orderpriority) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.o_orderpriority)) AS changed,
           count(*) FILTER (WHERE a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND
              (a.o_custkey, a.o_orderstatus, a.o_orderpriority) IS NOT DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.o_orderpriority)) AS unchanged
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    """,
)
def keyed_diff_summary(t):
    return J.diff_summary(*_order_versions(t), "o_orderkey")


@query(
    "detect_key_columns",
    """
    WITH u AS (SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS v FROM orders
      UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
      UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
      UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
    SELECT "column", count(*) AS "rows", count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values,
           count(v) = count(*) AND count(DISTINCT v) = count(*) AS is_key FROM u GROUP BY 1
    """,
)
def detect_key_columns(t):
    return J.detect_key(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "key_set_overlap",
    """
    WITH a AS (SELECT DISTINCT lower(trim(c_name)) AS k FROM customer), b AS (SELECT DISTINCT lower(trim(replace(s_name, 'Supplier', ' CUSTOMER'))) AS k FROM supplier)
    SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys,
           (SELECT count(*) FROM a JOIN b USING (k)) AS shared_keys,
           round((SELECT count(*) FROM a JOIN b USING (k)) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS overlap_rate
    """,
)
def key_set_overlap(t):
    b = t.supplier.withColumn("s_name", F.regexp_replace("s_name", "Supplier", " CUSTOMER"))
    return J.key_set_overlap(t.customer, "c_name", b, "s_name", salt="s1")


@query(
    "join_risk_check",
    """
    WITH s AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS k, count(DISTINCT o_orderpriority) AS g FROM orders)
    SELECT 'fan_out' AS "check", 'o_custkey' AS "column", CASE WHEN k / n < 0.5 THEN 'fail' WHEN k / n < 0.98 THEN 'warn' ELSE 'pass' END AS severity, round(k / n, 6) AS ratio FROM s
    UNION ALL SELECT 'additivity', 'o_orderpriority', CASE WHEN g / n < 0.98 THEN 'warn' ELSE 'pass' END, round(g / n, 6) FROM s
    UNION ALL SELECT 'key_type', 'o_custkey', 'pass', NULL
    """,
)
def join_risk_check(t):
    return J.check_join(t.customer, t.orders, "c_custkey", "o_custkey", ["o_orderpriority"], exact=True)


@query(
    "compare_two_results",
    """
    WITH a AS (SELECT o_orderstatus, o_orderpriority FROM orders), b AS (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000),
         x AS ((SELECT * FROM a) EXCEPT ALL (SELECT * FROM b)), y AS ((SELECT * FROM b) EXCEPT ALL (SELECT * FROM a))
    SELECT (SELECT count(*) FROM x) AS only_left, (SELECT count(*) FROM y) AS only_right,
           CASE WHEN (SELECT count(*) FROM x) = 0 AND (SELECT count(*) FROM y) = 0 THEN 'agree' ELSE 'mismatch' END AS verdict
    """,
)
def compare_two_results(t):
    a = t.orders.select("o_orderstatus", "o_orderpriority")
    return J.compare_results(a, t.orders.where("o_totalprice > 1000").select("o_orderstatus", "o_orderpriority"))


@query(
    "sql_passthrough_range_join",
    """
    SELECT r_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey AND o.o_totalprice > c.c_acctbal GROUP BY r_name
    """,
)
def sql_passthrough_range_join(t):
    """SQL text over registered tables, with an equi-join that carries a range condition."""
    from plumbline.operators.projection import sql

    return sql(
        {"orders": t.orders, "customer": t.customer, "nation": t.nation, "region": t.region},
        """SELECT r_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
           JOIN region r ON r.r_regionkey = n.n_regionkey AND o.o_totalprice > c.c_acctbal GROUP BY r_name""",
    )


@query(
    "asof_last_view",
    """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
       SELECT c.event_id, CASE WHEN epoch_us(c.ts) - epoch_us(v.ts) <= 259200000000 THEN v.view_id END AS view_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""",
)
def asof_last_view(t):
    """The last view of the same user within three days before each click."""
    view = t.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    click = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return O.asof_join(click, view, "ts", "ts", ["user_id"], tolerance=86400 * 3).select("event_id", "view_id")


@query(
    "points_in_bands",
    """SELECT s_suppkey, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS sizes FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 10 + s_suppkey % 7 * 40 GROUP BY 1""",
)
def points_in_bands(t):
    """Parts whose price lies in a supplier's band, bands of seven widths."""
    bands = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 10 + F.col("s_suppkey") % 7 * 40).alias("high"))
    met = O.sums_in_intervals(t.part, bands, "p_retailprice", "low", "high", "s_suppkey", ["p_size"])
    return met.select("s_suppkey", F.col("points").alias("parts"), F.col("p_size").alias("sizes"))


@query(
    "overlapping_stays",
    """WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS b FROM orders)
       SELECT x.o_custkey, count(*) AS pairs, CAST(sum(x.o_orderkey * 3 + y.o_orderkey) AS BIGINT) AS keys FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.a <= y.b AND y.a <= x.b AND x.o_orderkey % 2 = 0 AND y.o_orderkey % 2 = 1 GROUP BY 1""",
)
def overlapping_stays(t):
    """Stays of a customer that share a day, even order numbers against odd ones."""
    day = F.col("o_orderdate").cast("date")
    s = t.orders.select("o_orderkey", "o_custkey", day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 30).cast("int")).alias("b"))
    met = O.overlap_join(s.where("o_orderkey % 2 = 0"), s.where("o_orderkey % 2 = 1"), ("a", "b"), ("a", "b"), ["o_custkey"])
    return met.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("o_orderkey") * 3 + F.col("o_orderkey_right")).alias("keys"))
