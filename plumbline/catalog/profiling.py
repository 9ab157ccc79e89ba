"""Profiles and fingerprints of whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions.text import leading_digit
from plumbline.plans import profile as P

ORDERS_LONG = """(SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
   UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)"""
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def rnd(df, names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


@query(
    "column_profile",
    f"""WITH u AS {ORDERS_LONG}, f AS (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rk FROM u WHERE value IS NOT NULL GROUP BY 1, 2),
            g AS (SELECT "column", count(*) AS d, sum(n) AS nn, list(value ORDER BY rk) FILTER (WHERE rk <= 5) AS top_values FROM f GROUP BY 1), t AS (SELECT count(*) AS "rows" FROM orders)
        SELECT g."column", CASE WHEN g."column" IN ('o_orderkey', 'o_custkey') THEN 'number' ELSE 'text' END AS kind, "rows", round(("rows" - nn) / "rows", 6) AS null_rate, d AS distinct_values,
               CASE g."column" WHEN 'o_orderkey' THEN (SELECT CAST(min(o_orderkey) AS DOUBLE) FROM orders) WHEN 'o_custkey' THEN (SELECT CAST(min(o_custkey) AS DOUBLE) FROM orders) END AS min,
               CASE g."column" WHEN 'o_orderkey' THEN (SELECT CAST(max(o_orderkey) AS DOUBLE) FROM orders) WHEN 'o_custkey' THEN (SELECT CAST(max(o_custkey) AS DOUBLE) FROM orders) END AS max,
               top_values, 100 AS quality FROM g, t""",
)
def column_profile(t):
    return P.column_profile(t.orders.select(*ORDERS_COLS))


@query(
    "top_values",
    f"""WITH f AS (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rank FROM {ORDERS_LONG} GROUP BY 1, 2) SELECT * FROM f WHERE rank <= 5""",
)
def top_values(t):
    return P.top_values(t.orders.select(*ORDERS_COLS))


@query(
    "distribution_fingerprint",
    """WITH s AS (SELECT count(*) AS n FROM lineitem),
            num AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
            cat AS (SELECT 'l_returnflag' AS "column", l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
            cf AS (SELECT "column", v, count(*) AS c, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS rk FROM cat WHERE v IS NOT NULL GROUP BY 1, 2)
       SELECT "column", 'numeric' AS kind, CAST(0 AS DOUBLE) AS null_rate, round(count(DISTINCT x) / count(x), 6) AS cardinality, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(skewness(x), 5) AS skew, min(x) AS min, max(x) AS max, NULL AS top, NULL AS top_prop FROM num GROUP BY 1
       UNION ALL SELECT "column", 'categorical', 0.0, round(count(*) / sum(c), 6), NULL, NULL, NULL, NULL, NULL, list(v ORDER BY rk) FILTER (WHERE rk <= 5), round(max(c) / sum(c), 6) FROM cf GROUP BY 1""",
)
def distribution_fingerprint(t):
    f = P.fingerprint(t.lineitem.select("l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus"))
    return rnd(rnd(f, ["cardinality", "top_prop", "null_rate"]), ["mean", "std", "skew"], 5)


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
_NUM_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count({c}) AS non_null, min({c}) AS min, max({c}) AS max, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS sigma,
        round(quantile_cont({c}, 0.05), 5) AS p05, round(median({c}), 5) AS median, round(quantile_cont({c}, 0.95), 5) AS p95,
        count(*) FILTER (WHERE abs({c} - (SELECT avg({c}) FROM lineitem)) > 3 * (SELECT stddev_pop({c}) FROM lineitem)) AS outliers,
        round(count(*) FILTER (WHERE {c} = 0) / count({c}), 6) AS zero_share, round(count(*) FILTER (WHERE {c} < 0) / count({c}), 6) AS negative_share FROM lineitem"""
    for c in _NUM
)


@query("numeric_profile", _NUM_SQL)
def numeric_profile(t):
    p = P.numeric_profile(t.lineitem, _NUM)
    return rnd(rnd(p, ["zero_share", "negative_share"]), ["mean", "sigma", "p05", "median", "p95"], 5)


@query(
    "categorical_profile",
    """WITH u AS (SELECT 'lang' AS "column", lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents),
            f AS (SELECT "column", v, count(*) AS c, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS rk FROM u WHERE v IS NOT NULL AND trim(v, ' ') <> '' GROUP BY 1, 2)
       SELECT "column", (SELECT count(*) FROM documents) AS "rows", CAST(sum(c) AS BIGINT) AS non_null, count(*) AS distinct_values, max(v) FILTER (WHERE rk = 1) AS top_value, max(c) AS top_count, round(max(c) / sum(c), 6) AS top_share,
              count(*) / sum(c) > 0.9 AND count(*) > 20 AS id_like FROM f GROUP BY 1""",
)
def categorical_profile(t):
    return rnd(P.categorical_profile(t.documents, ["lang", "source", "text"]), ["top_share"])


@query("insight_candidates")
def insight_candidates(t):
    return P.insight_candidates(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"))


@query(
    "concentration",
    """WITH g AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
       SELECT 'c_nationkey' AS category, count(*) AS groups, round(sum(v) / (SELECT sum(c_acctbal) FROM customer), 6) AS share, sum(v) / (SELECT sum(c_acctbal) FROM customer) >= 0.5 AS concentrated FROM g""",
)
def concentration(t):
    return rnd(P.concentration(t.customer, "c_nationkey", "c_acctbal"), ["share"])


@query(
    "preflight",
    """WITH d AS (SELECT d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), g AS (SELECT count(*) AS c FROM d GROUP BY ALL d.lang, d.source, d.quality)
       SELECT 'rows' AS "check", CAST(count(*) AS DOUBLE) AS value, 'pass' AS status FROM d
       UNION ALL SELECT 'columns', 3.0, 'pass' UNION ALL SELECT 'columns_with_nulls', 1.0, 'warn'
       UNION ALL SELECT 'duplicate_rows', CAST((SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM d GROUP BY lang, source, quality)) AS DOUBLE), 'warn' UNION ALL SELECT 'freshness_hours', 5.0, 'pass'""".replace(
        ", g AS (SELECT count(*) AS c FROM d GROUP BY ALL d.lang, d.source, d.quality)", ""
    ),
)
def preflight(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("lang", "source", "quality")
    return P.preflight(d, F.lit(5.0))


@query(
    "readiness_gate",
    """WITH d AS (SELECT d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (SELECT count(*) AS n FROM d),
            u AS (SELECT (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM d GROUP BY lang, n_chars, quality)) AS dup, count(*) FILTER (WHERE quality IS NULL) AS q, count(*) FILTER (WHERE n_chars IS NULL) AS nc, count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') AS la FROM d),
            f AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM d), g AS (SELECT quantile_cont(quality, 0.25) AS q1, quantile_cont(quality, 0.75) AS q3 FROM d)
       SELECT 'row_count' AS "check", NULL AS "column", CASE WHEN n = 0 THEN 'block' WHEN n < 30 THEN 'warn' ELSE 'pass' END AS severity, CAST(n AS DOUBLE) AS value FROM n
       UNION ALL SELECT 'duplicates', NULL, CASE WHEN dup / n > 0.01 THEN 'block' WHEN dup > 0 THEN 'warn' ELSE 'pass' END, round(dup / n, 6) FROM n, u
       UNION ALL SELECT 'empty', 'quality', CASE WHEN q / n > 0.3 THEN 'block' WHEN q / n > 0.1 THEN 'warn' ELSE 'pass' END, round(q / n, 6) FROM n, u
       UNION ALL SELECT 'empty', 'n_chars', CASE WHEN nc / n > 0.3 THEN 'block' ELSE 'pass' END, round(nc / n, 6) FROM n, u
       UNION ALL SELECT 'empty', 'lang', CASE WHEN la / n > 0.1 THEN 'warn' ELSE 'pass' END, round(la / n, 6) FROM n, u
       UNION ALL SELECT 'outliers', 'n_chars', 'info', CAST(count(*) AS DOUBLE) FROM d, f WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0
       UNION ALL SELECT 'outliers', 'quality', 'info', CAST(count(*) AS DOUBLE) FROM d, g WHERE quality < q1 - 1.5 * (q3 - q1) OR quality > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0""",
)
def readiness_gate(t):
    return P.readiness(t.documents.join(t.labels, "doc_id", "left").select("lang", "n_chars", "quality"))


@query(
    "leading_digits",
    """SELECT CAST(substr(replace(CAST(CAST(abs(l_extendedprice) AS DECIMAL(18, 2)) AS VARCHAR), '.', ''), 1, 1) AS BIGINT) AS digit, count(*) AS n FROM lineitem WHERE abs(l_extendedprice) >= 1 GROUP BY 1""",
)
def leading_digits(t):
    x = F.abs("l_extendedprice")
    return t.lineitem.where(x >= 1).groupBy(leading_digit(x).cast("long").alias("digit")).agg(F.count(F.lit(1)).alias("n"))
