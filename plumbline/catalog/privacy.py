"""Identifier scans, anonymity, noised and synthetic outputs, fingerprint comparison."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import privacy as K


@query(
    "identifier_scan",
    r"""WITH u AS (SELECT count(*) FILTER (WHERE regexp_matches(trim(url), '(?i)^https?://\S+$')) / count(url) AS s FROM pages)
        SELECT 'url' AS category, 'url' AS "column", true AS by_name, round(s, 6) AS value_share FROM u UNION ALL SELECT 'other', 'page_id', true, NULL FROM u""",
)
def identifier_scan(t):
    return K.scan_identifiers(t.pages)


@query(
    "identifier_scan_values",
    r"""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS seen, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || CAST(o_orderkey AS VARCHAR) || '@mail.org' ELSE 'none' END AS contact, o_custkey % 95 AS age FROM orders)
        SELECT 'dates' AS category, 'seen' AS "column", false AS by_name, CAST(1 AS DOUBLE) AS value_share UNION ALL SELECT 'telephone', 'seen', false, 1.0 UNION ALL SELECT 'dates', 'age', false, NULL""",
)
def identifier_scan_values(t):
    k = F.col("o_orderkey")
    d = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"), F.when(k % 3 == 0, F.concat(F.lit("u"), k, F.lit("@mail.org"))).otherwise("none").alias("contact"), (F.col("o_custkey") % 95).alias("age"))
    return K.scan_identifiers(d)


@query(
    "k_anonymity",
    """WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)
       SELECT count(*) AS groups, min(n) AS k_floor, count(*) FILTER (WHERE n < 5) AS small_groups, CAST(coalesce(sum(n) FILTER (WHERE n < 5), 0) AS BIGINT) AS rows_at_risk, CASE WHEN min(n) >= 5 THEN 'none' WHEN min(n) = 1 THEN 'high' WHEN min(n) < 3 THEN 'medium' ELSE 'low' END AS level FROM g""",
)
def k_anonymity(t):
    return K.k_anonymity(t.customer, ["c_nationkey", "c_mktsegment"])


SECRET = "for tests only"


def _draw(text: str) -> str:
    """SQL of the keyed uniform draw for a text."""
    return f"((CAST('0x' || substr(sha256('{SECRET}:' || sha256('{SECRET}:' || {text})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _noised(scale: float) -> str:
    """SQL of a count n with Laplace noise from its draw u."""
    return f"greatest(0.0, n - {scale} * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)))"


@query("noised_counts", f"WITH g AS (SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1), d AS (SELECT *, {_draw('key')} AS u FROM g) SELECT key, round({_noised(2.0)}, 6) AS noised FROM d")
def noised_counts(t):
    return K.noised_counts(t.customer, "c_mktsegment", 0.5, SECRET).withColumn("noised", F.round("noised", 6))


# Three orders of each customer, by keyed draw.
BOUNDED_SQL = f"""(SELECT * FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY {_draw("'row:' || CAST(o_orderkey AS VARCHAR)")}, o_orderkey) AS place FROM orders) WHERE place <= 3)"""


@query("bounded_sums", f"SELECT o_orderpriority AS key, round(sum(least(150000.0, o_totalprice)), 2) AS total, count(*) AS n FROM {BOUNDED_SQL} GROUP BY 1")
def bounded_sums(t):
    """Order values by priority, each customer held to three orders of at most 150,000."""
    return K.bounded_sums(t.orders, "o_orderpriority", "o_totalprice", "o_custkey", "o_orderkey", SECRET, 3, 150_000.0).withColumn("total", F.round("total", 2))


@query(
    "noised_sums",
    f"""WITH r AS {BOUNDED_SQL}, c AS (SELECT CAST(ceil(log2(o_totalprice)) AS INTEGER) AS power, count(*) AS n FROM r GROUP BY 1),
             u AS (SELECT power, {_draw("'bound:' || CAST(power AS VARCHAR)")} AS u, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(-64, 64)) AS INTEGER) AS power) LEFT JOIN c USING (power)),
             h AS (SELECT power, {_noised(15.0)} AS n FROM u), s AS (SELECT power, sum(n) OVER (ORDER BY power) AS upto, sum(n) OVER () AS total FROM h),
             b AS (SELECT pow(2.0, min(power)) AS bound FROM s WHERE upto >= 0.95 * total),
             g AS (SELECT o_orderpriority AS key, bound, sum(least(bound, o_totalprice)) AS total, count(*) AS n FROM r, b GROUP BY 1, 2),
             d AS (SELECT *, {_draw("'total:g' || key")} - 0.5 AS ut, {_draw("'count:g' || key")} AS u FROM g),
             f AS (SELECT key, bound, total - bound * 3 / 0.4 * sign(ut) * ln(1 - 2 * abs(ut)) AS total, {_noised(7.5)} AS n FROM d)
        SELECT key, round(total, 1) AS total, round(n, 4) AS n, round(greatest(-bound, least(bound, total / greatest(1.0, n))), 4) AS mean, bound FROM f""",
)
def noised_sums(t):
    """Sums, counts and means of order values by priority, with noise fitted to what one customer can change."""
    s = K.noised_sums(t.orders, "o_orderpriority", "o_totalprice", "o_custkey", "o_orderkey", 1.0, SECRET, 3)
    return s.select("key", F.round("total", 1).alias("total"), F.round("n", 4).alias("n"), F.round("mean", 4).alias("mean"), "bound")


@query(
    "private_histogram",
    f"""WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
             b AS (SELECT CAST(least(19, floor((o_totalprice - lo) / w)) AS INTEGER) AS bin, count(*) AS c FROM orders, s GROUP BY 1),
             g AS (SELECT CAST(r AS INTEGER) AS bin, coalesce(c, 0) AS n FROM unnest(generate_series(0, 19)) AS x(r) LEFT JOIN b ON r = bin),
             d AS (SELECT *, {_draw("'o_totalprice:' || bin")} AS u FROM g)
        SELECT bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, CAST(NULL AS VARCHAR) AS label, round({_noised(1.0)}, 6) AS weight FROM d, s""",
)
def private_histogram(t):
    h = K.private_histogram(t.orders, "o_totalprice", SECRET)
    return h.withColumns({"low": F.round("low", 4), "high": F.round("high", 4), "weight": F.round("weight", 6)})


@query("synthetic_rows")
def synthetic_rows(t):
    """As many synthetic orders as there are real ones."""
    n = t.orders.count()
    return K.synthetic_rows(t.orders, ["o_totalprice", "o_orderstatus", "o_orderpriority"], n, SECRET)


@query("synthetic_comparison")
def synthetic_comparison(t):
    s = K.synthetic_rows(t.orders, ["o_totalprice", "o_custkey"], t.orders.count(), SECRET)
    return K.compare_statistics(t.orders, s, ["o_totalprice", "o_custkey"])


@query(
    "shareable_fingerprint",
    """WITH s AS (SELECT count(*) AS n, floor(min(o_totalprice) / power(10, floor(log10(abs(min(o_totalprice)))) - 1)) * power(10, floor(log10(abs(min(o_totalprice)))) - 1) AS lo,
              ceil(max(o_totalprice) / power(10, floor(log10(abs(max(o_totalprice)))) - 1)) * power(10, floor(log10(abs(max(o_totalprice)))) - 1) AS hi FROM orders),
            b AS (SELECT CAST(least(15, greatest(0, floor((o_totalprice - lo) / ((hi - lo) / 16)))) AS INTEGER) AS bin, count(*) AS c FROM orders, s GROUP BY 1)
       SELECT 'o_totalprice' AS "column", 'numeric' AS kind, CAST(r AS VARCHAR) AS bin, round(lo, 4) AS low, round(hi, 4) AS high, round(coalesce(c, 0) / n, 6) AS p FROM (SELECT unnest(generate_series(0, 15)) AS r) LEFT JOIN b ON r = bin, s
       UNION ALL SELECT 'o_orderstatus', 'categorical', o_orderstatus, NULL, NULL, round(count(*) / (SELECT n FROM s), 6) FROM orders GROUP BY o_orderstatus""",
)
def shareable_fingerprint(t):
    f = K.shareable_fingerprint(t.orders, ["o_totalprice", "o_orderstatus"], epsilon=None)
    return f.withColumns({c: F.round(c, 4) for c in ("low", "high")}).withColumn("p", F.round("p", 6))


@query(
    "compare_shapes",
    """WITH d AS (SELECT o_orderstatus AS v, o_orderkey % 2 AS s FROM orders), p AS (SELECT v, count(*) FILTER (WHERE s = 0) / (SELECT count(*) FROM d WHERE s = 0) AS p, count(*) FILTER (WHERE s = 1) / (SELECT count(*) FROM d WHERE s = 1) AS q FROM d GROUP BY 1),
            x AS (SELECT sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) AS j FROM p)
       SELECT 'o_orderstatus' AS "column", round(j, 6) AS jsd, j > 0.1 AS differs FROM x""",
)
def compare_shapes(t):
    f = lambda d: K.shareable_fingerprint(d, ["o_orderstatus"], epsilon=None)
    k = F.col("o_orderkey") % 2
    return K.compare_shapes(f(t.orders.where(k == 0)), f(t.orders.where(k == 1))).withColumn("jsd", F.round("jsd", 6))


@query("compare_shapes_numeric")
def compare_shapes_numeric(t):
    f = lambda d: K.shareable_fingerprint(d, ["o_totalprice", "o_custkey"], epsilon=None)
    cheap = t.orders.where("o_totalprice < 200000")
    return K.compare_shapes(f(t.orders), f(cheap))
