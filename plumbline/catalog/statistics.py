"""Intervals, tests, anomaly scores, robustness."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import anomaly as N
from plumbline.operators import stats as S


def rnd(df, names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


@query(
    "diagonal_distance",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS sb, avg(l_discount) AS c, stddev_pop(l_discount) AS sc FROM lineitem),
            d AS (SELECT l_returnflag, sqrt(power((l_quantity - a) / sa, 2) + power((l_extendedprice - b) / sb, 2) + power((l_discount - c) / sc, 2)) AS distance FROM lineitem, m)
       SELECT l_returnflag, distance > 3 AS is_anomaly, count(*) AS n, round(max(distance), 5) AS farthest FROM d GROUP BY 1, 2""",
)
def diagonal_distance(t):
    d = N.diagonal_distance(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return d.groupBy("l_returnflag", "is_anomaly").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("distance"), 5).alias("farthest"))


@query(
    "explain_by_peers",
    """WITH g AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer GROUP BY 1), z AS (SELECT c_custkey AS key, (c_acctbal - m) / s AS za, (c_nationkey - m2) / s2 AS zb FROM customer JOIN g ON k = c_mktsegment)
       SELECT key, 'c_acctbal' AS feature, round(za, 5) AS z, round(za * za / (za * za + zb * zb), 5) AS contribution FROM z UNION ALL SELECT key, 'c_nationkey', round(zb, 5), round(zb * zb / (za * za + zb * zb), 5) FROM z""",
)
def explain_by_peers(t):
    group = N.peer_group_column(t.customer, ["c_name", "c_mktsegment"])
    return rnd(N.explain_by_peers(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], group), ["z", "contribution"], 5)


@query(
    "control_chart",
    """WITH m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events)
       SELECT 'value' AS "column", n, round(mu, 5) AS mean, round(sd, 5) AS sigma, round(mu - 3 * sd, 5) AS lcl, round(mu + 3 * sd, 5) AS ucl, (SELECT count(*) FROM events, m WHERE value > mu + 3 * sd OR value < mu - 3 * sd) AS out_of_control, round(least((hi - mu) / (3 * sd), (mu - lo) / (3 * sd)), 3) AS cpk FROM m""",
)
def control_chart(t):
    return rnd(N.control_chart(t.events, ["value"]), ["mean", "sigma", "lcl", "ucl"], 5)


@query(
    "entity_deviation",
    """WITH g AS (SELECT user_id AS u, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id, user_id, value, round((value - m) / s, 5) AS z FROM events JOIN g ON u = user_id WHERE abs((value - m) / s) > 3""",
)
def entity_deviation(t):
    return rnd(N.entity_deviation(t.events, ["user_id"], "value").select("event_id", "user_id", "value", "z"), ["z"], 5)


@query(
    "value_spikes",
    """WITH m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events) SELECT event_id, round((value - mu) / sd, 5) AS z, CASE WHEN value > mu THEN 'spike' ELSE 'drop' END AS kind,
       CASE WHEN abs((value - mu) / sd) >= 4 THEN 'critical' WHEN abs((value - mu) / sd) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM events, m WHERE abs((value - mu) / sd) >= 2.5""",
)
def value_spikes(t):
    return rnd(N.spikes(t.events, "value").select("event_id", "z", "kind", "severity"), ["z"], 5)


@query("isolation_forest")
def isolation_forest(t):
    d = t.lineitem.withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return N.isolation_forest(d, ["l_quantity", "l_extendedprice", "l_discount"], "id")


@query(
    "gower_knn_scores",
    """WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) - min(c_acctbal) AS span, least(greatest(3, least(10, count(*) - 1)), count(*) - 1) AS near FROM customer),
            p AS (SELECT a.c_custkey, near, abs(a.c_acctbal - b.c_acctbal) / span AS t0, CAST(a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AS INTEGER) AS t1,
                         CAST(a.c_nationkey IS DISTINCT FROM b.c_nationkey AS INTEGER) AS t2 FROM e, customer a JOIN customer b ON a.c_custkey <> b.c_custkey),
            r AS (SELECT *, (t0 + t1 + t2) / 3 AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY (t0 + t1 + t2) / 3, t0, t1, t2) AS rn FROM p)
       SELECT c_custkey, round(avg(dist), 6) AS raw_score, round(sum(t0) / greatest(sum(t0 + t1 + t2), 1e-12), 4) AS acctbal_share FROM r WHERE rn <= near GROUP BY 1""",
)
def gower_knn_scores(t):
    """Every customer against all others; the SQL forms all pairs."""
    s = N.gower_knn(t.customer, "c_custkey", ["c_acctbal"], ["c_mktsegment", "c_nationkey"])
    return s.select(F.col("key").alias("c_custkey"), F.round("raw_score", 6).alias("raw_score"), F.col("contributions")["c_acctbal"].alias("acctbal_share"))


@query("gower_knn")
def gower_knn(t):
    s = N.gower_knn(t.customer, "c_custkey", ["c_acctbal"], ["c_mktsegment", "c_nationkey"])
    return N.suppress_dismissed(N.flag_outlying_scores(s), ["c_nationkey"])


@query(
    "mean_interval",
    """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS lower, round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS upper,
       CASE WHEN count(*) >= 30 THEN 'sufficient' WHEN count(*) >= 10 THEN 'low' ELSE 'insufficient' END AS verdict FROM orders GROUP BY 1""",
)
def mean_interval(t):
    return rnd(S.mean_interval(t.orders, "o_totalprice", ["o_orderpriority"]).drop("sd"), ["mean", "lower", "upper"], 4)


@query(
    "effect_size",
    """WITH s AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'R') AS nb, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS mb, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') AS vb FROM lineitem),
            d AS (SELECT na, nb, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s)
       SELECT na, nb, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM d""",
)
def effect_size(t):
    return rnd(S.cohens_d(t.lineitem, "l_quantity", "l_returnflag", "A", "R"), ["d"])


@query(
    "simpson_check",
    """WITH g AS (SELECT o_orderpriority AS segment, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS sa, count(*) FILTER (WHERE o_orderstatus = 'F') AS na, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS sb, count(*) FILTER (WHERE o_orderstatus = 'O') AS nb FROM orders GROUP BY 1),
            o AS (SELECT CASE WHEN sum(sa) / sum(na) > sum(sb) / sum(nb) THEN 'A' ELSE 'B' END AS overall FROM g)
       SELECT segment, na, nb, CASE WHEN sa / na > sb / nb THEN 'A' ELSE 'B' END AS direction, overall, (CASE WHEN sa / na > sb / nb THEN 'A' ELSE 'B' END) <> overall AS reversed FROM g, o""",
)
def simpson_check(t):
    return S.simpson_check(t.orders, "o_totalprice", "o_orderstatus", "o_orderpriority", "F", "O")


@query(
    "weakest_group",
    """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS "group", count(value) AS n FROM events GROUP BY 1), v AS (SELECT *, CASE WHEN n >= 30 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END AS r FROM g)
       SELECT CASE r WHEN 2 THEN 'sufficient' WHEN 1 THEN 'low' ELSE 'insufficient' END AS verdict, "group", n, (SELECT count(*) FROM g) AS groups FROM v ORDER BY r, n, "group" LIMIT 1""",
)
def weakest_group(t):
    return S.weakest_group(S.grouped_confidence(t.events, "user_id", "value"))


@query(
    "correlation_matrix",
    """SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""",
)
def correlation_matrix(t):
    return rnd(S.correlation_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), ["r"])


@query(
    "simple_regression",
    """SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
       round(corr(l_extendedprice, l_quantity) * sqrt(count(*) - 2) / sqrt(1 - power(corr(l_extendedprice, l_quantity), 2)), 3) AS t FROM lineitem""",
)
def simple_regression(t):
    r = S.regression(t.lineitem, "l_extendedprice", "l_quantity")
    return r.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("t", 3).alias("t"))


@query(
    "chi_square_independence",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
            e AS (SELECT r.a, k.b, ra * cb / n AS e FROM r, k, n)
       SELECT round(sum(power(coalesce(o, 0) - e, 2) / e), 5) AS chi_square, CAST((count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS DOUBLE) AS df FROM e LEFT JOIN c ON c.a = e.a AND c.b = e.b""",
)
def chi_square_independence(t):
    return rnd(S.chi_square(t.orders, "o_orderstatus", "o_orderpriority").drop("p"), ["chi_square"], 5)


@query(
    "one_sample_t",
    "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round((avg(o_totalprice) - 250000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 5) AS t FROM orders",
)
def one_sample_t(t):
    return S.one_sample_t(t.orders, "o_totalprice", 250000).select("n", F.round("mean", 4).alias("mean"), F.round("t", 5).alias("t"))


@query("test_p_values")
def test_p_values(t):
    """p-values of the regression, independence and one-sample tests."""
    a = S.regression(t.lineitem, "l_extendedprice", "l_quantity").select(F.lit("regression").alias("test"), "p")
    b = S.chi_square(t.orders, "o_orderstatus", "o_orderpriority").select(F.lit("chi_square").alias("test"), "p")
    c = S.one_sample_t(t.orders, "o_totalprice", 250000).select(F.lit("one_sample").alias("test"), "p")
    return a.unionByName(b).unionByName(c).withColumn("alpha", F.lit(S.bonferroni(3)))


@query("bootstrap_mean")
def bootstrap_mean(t):
    return S.bootstrap_mean(t.orders, "o_totalprice", "o_orderkey")


@query("stress_test")
def stress_test(t):
    return S.stress_test(t.orders, "o_totalprice", "o_orderkey", "o_orderpriority")


@query(
    "trimmed_mean",
    """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, count(*) OVER () AS n FROM orders), m AS (SELECT avg(o_totalprice) AS b FROM orders), k AS (SELECT avg(v) AS m FROM o WHERE pos > floor(n * 0.05) AND pos <= n - floor(n * 0.05))
       SELECT 'trim' AS "check", round(abs(m - b) / abs(b), 6) AS change, abs(m - b) / abs(b) <= 0.10 AS robust FROM k, m""",
)
def trimmed_mean(t):
    return rnd(S.stress_test(t.orders, "o_totalprice", "o_orderkey").where(F.col("check") == "trim"), ["change"])


GAP_SQL = """(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS grp, o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1.05 ELSE 1 END AS v FROM orders)"""


def gap_table(t):
    f = F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", F.when(f, "A").otherwise("B").alias("grp"), (F.col("o_totalprice") * F.when(f, 1.05).otherwise(1.0)).alias("v"))


@query(
    "rows_to_break_gap",
    f"""WITH d AS {GAP_SQL}, s AS (SELECT avg(v) FILTER (WHERE grp = 'A') AS ma, avg(v) FILTER (WHERE grp = 'B') AS mb, count(*) FILTER (WHERE grp = 'A') AS na, count(*) FILTER (WHERE grp = 'B') AS nb, sum(v) FILTER (WHERE grp = 'A') AS sa, sum(v) FILTER (WHERE grp = 'B') AS sb FROM d),
         p AS (SELECT o_orderkey, grp, v, CASE WHEN ma >= mb THEN 1 ELSE -1 END * CASE WHEN grp = 'A' THEN (v - ma) / (na - 1) ELSE (mb - v) / (nb - 1) END AS pull FROM d, s),
         r AS (SELECT row_number() OVER w AS pos, sum(CASE WHEN grp = 'A' THEN v ELSE 0 END) OVER w AS ra, sum(CASE WHEN grp = 'A' THEN 1 ELSE 0 END) OVER w AS ca, sum(CASE WHEN grp = 'B' THEN v ELSE 0 END) OVER w AS rb, sum(CASE WHEN grp = 'B' THEN 1 ELSE 0 END) OVER w AS cb FROM p WINDOW w AS (ORDER BY -pull, o_orderkey ROWS UNBOUNDED PRECEDING)),
         l AS (SELECT pos, (sa - ra) / nullif(na - ca, 0) - (sb - rb) / nullif(nb - cb, 0) AS e, ma - mb AS g, na + nb AS n FROM r, s), h AS (SELECT min(pos) AS k, arg_min(sign(e) <> sign(g), pos) AS rv, max(g) AS g, max(n) AS n FROM l WHERE sign(e) <> sign(g) OR abs(e) <= 0.25 * abs(g))
        SELECT round(g, 4) AS gap, k AS rows_to_break, n AS "rows", round(k / n, 6) AS fraction, CASE WHEN rv THEN 'reverses' ELSE 'disappears' END AS mode, CASE WHEN k / n <= 0.1 THEN 'fragile' WHEN k / n <= 0.3 THEN 'moderate' ELSE 'robust' END AS severity FROM h""",
)
def rows_to_break_gap(t):
    g = S.rows_to_break_gap(gap_table(t), "v", "grp", "A", "B", "o_orderkey")
    return g.withColumns({"gap": F.round("gap", 4), "fraction": F.round("fraction", 6)})


@query(
    "fewest_rows_to_break",
    f"""WITH d AS {GAP_SQL}, s AS (SELECT avg(v) FILTER (WHERE grp = 'A') AS ma, avg(v) FILTER (WHERE grp = 'B') AS mb FROM d), g AS (SELECT ma - mb AS gap, CASE WHEN ma >= mb THEN 'A' ELSE 'B' END AS hi FROM s),
         h AS (SELECT row_number() OVER (ORDER BY v DESC, o_orderkey) AS i, sum(v) OVER () AS t, count(*) OVER () AS n, sum(v) OVER (ORDER BY v DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS r FROM d, g WHERE grp = hi),
         l AS (SELECT row_number() OVER (ORDER BY v, o_orderkey) AS j, sum(v) OVER () AS t, count(*) OVER () AS n, sum(v) OVER (ORDER BY v, o_orderkey ROWS UNBOUNDED PRECEDING) AS r FROM d, g WHERE grp <> hi),
         a AS (SELECT 0 AS i, greatest(ma, mb) AS m FROM s UNION ALL SELECT i, (t - r) / (n - i) FROM h WHERE i < n), b AS (SELECT 0 AS j, least(ma, mb) AS m FROM s UNION ALL SELECT j, (t - r) / (n - j) FROM l WHERE j < n),
         f AS (SELECT x.i, y.j, x.m - y.m AS remains FROM (SELECT i, m, m - 0.25 * abs(gap) AS need FROM a, g) x ASOF JOIN (SELECT min(j) AS j, m FROM b GROUP BY m) y ON x.need <= y.m),
         k AS (SELECT * FROM f ORDER BY i + j, i LIMIT 1), n AS (SELECT count(*) AS n FROM d WHERE grp IN ('A', 'B')),
         gone AS (SELECT v, o_orderkey, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN grp = hi THEN -v ELSE v END, o_orderkey) AS p FROM d, g WHERE grp IN ('A', 'B')), k, g WHERE p <= CASE WHEN grp = g.hi THEN k.i ELSE k.j END),
         seg AS (SELECT 'grp = ' || grp AS segment, count(*) AS c FROM gone GROUP BY grp ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT round(gap, 4) AS gap, CAST(i + j AS BIGINT) AS rows_to_break, CAST(i AS BIGINT) AS from_higher, CAST(j AS BIGINT) AS from_lower, n AS "rows", round((i + j) / n, 6) AS fraction,
               CASE WHEN remains < 0 THEN 'reverses' ELSE 'disappears' END AS mode, CASE WHEN (i + j) / n <= 0.1 THEN 'fragile' WHEN (i + j) / n <= 0.3 THEN 'moderate' ELSE 'robust' END AS severity,
               segment, round(c / (i + j), 6) AS segment_share FROM g, k, n, seg""",
)
def fewest_rows_to_break(t):
    """The fewest rows that carry the gap of two groups, and the group most of them are in."""
    g = S.fewest_rows_to_break_gap(gap_table(t), "v", "grp", "A", "B", "o_orderkey", ["grp"])
    return g.withColumns({"gap": F.round("gap", 4), "fraction": F.round("fraction", 6), "segment_share": F.round("segment_share", 6)})


@query("robustness_verdict")
def robustness_verdict(t):
    d = gap_table(t)
    return S.robustness_verdict(S.stress_test(d, "v", "o_orderkey", "grp"), S.rows_to_break_gap(d, "v", "grp", "A", "B", "o_orderkey"))


@query("flag_ranking")
def flag_ranking(t):
    """Acceptance learned from document labels, scored for every document."""
    d = t.documents.select("doc_id", F.log1p("n_chars").alias("size"), (F.col("lang") == "en").cast("double").alias("english"), F.length("text").cast("double").alias("chars"))
    return S.flag_ranking(d.join(t.labels, "doc_id"), ["size", "english", "chars"], "quality", d).select("doc_id", "accept_probability")


@query(
    "exact_quantiles",
    """SELECT 'l_extendedprice' AS "column", CAST(p AS DOUBLE) AS prob, round(v, 5) AS value FROM (SELECT unnest([0.01, 0.5, 0.999]) AS p, unnest(quantile_cont(l_extendedprice, [0.01, 0.5, 0.999])) AS v FROM lineitem)
       UNION ALL SELECT 'l_discount', p, round(v, 5) FROM (SELECT unnest([0.01, 0.5, 0.999]) AS p, unnest(quantile_cont(l_discount, [0.01, 0.5, 0.999])) AS v FROM lineitem)""",
)
def exact_quantiles(t):
    from plumbline.functions.stats import exact_quantiles as q

    return rnd(q(t.lineitem, ["l_extendedprice", "l_discount"], [0.01, 0.5, 0.999]), ["value"], 5)
