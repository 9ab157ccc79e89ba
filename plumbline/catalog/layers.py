"""Validation layers, grades, equity and claim checks on tables derived from the shared ones."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.plans import checks as K
from plumbline.plans import layers as L
from plumbline.operators.drift import snapshot
from plumbline.plans.profile import fingerprint
from plumbline.plans.validate import History, Story, validate

# An encounter table derived row by row from the whole orders table.
ENC_SQL = """(SELECT o_orderkey AS encounter_id, CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_custkey END AS patient_id, CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'female' END AS sex,
   CASE WHEN o_custkey % 97 = 1 THEN 210 WHEN o_custkey % 89 = 2 THEN -1 ELSE o_custkey % 95 END AS age, CAST(o_orderdate AS DATE) AS admit_date,
   CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 AS INTEGER) - 1 AS discharge_date, o_orderkey % 12 - 1 + CASE WHEN o_orderkey % 31 = 0 THEN 5 ELSE 0 END AS length_of_stay,
   CASE WHEN o_orderkey % 40 = 3 THEN 'yes' ELSE 'no' END AS pregnant, CASE WHEN o_orderkey % 6 = 0 THEN 'true' ELSE 'false' END AS has_retirement_account,
   CASE WHEN o_orderkey % 25 = 0 THEN -o_totalprice ELSE o_totalprice END AS claim_amount, o_totalprice * 0.8 AS allowed_amount, CASE WHEN o_orderkey % 19 = 0 THEN o_totalprice ELSE o_totalprice * 0.7 END AS paid_amount,
   CAST(o_orderkey % 3 = 0 AS INTEGER) AS readmit_30d, CAST(o_orderkey % 6 = 0 OR o_orderkey % 3 = 1 AS INTEGER) AS readmit_90d, (o_orderkey * 37) % 420 AS systolic, (o_orderkey * 53) % 300 AS diastolic,
   CAST(o_orderkey % 104 AS DOUBLE) AS success_rate, o_orderstatus, o_orderpriority FROM orders)"""


def encounters(t):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        k.alias("encounter_id"), F.when(k % 50 == 7, None).otherwise(c).alias("patient_id"), F.when(c % 2 == 0, "Male").otherwise("female").alias("sex"),
        F.when(c % 97 == 1, 210).when(c % 89 == 2, -1).otherwise(c % 95).alias("age"), d.alias("admit_date"),
        F.date_add(d, (k % 12 - 1).cast("int")).alias("discharge_date"), (k % 12 - 1 + F.when(k % 31 == 0, 5).otherwise(0)).alias("length_of_stay"),
        F.when(k % 40 == 3, "yes").otherwise("no").alias("pregnant"), F.when(k % 6 == 0, "true").otherwise("false").alias("has_retirement_account"),
        F.when(k % 25 == 0, -p).otherwise(p).alias("claim_amount"), (p * 0.8).alias("allowed_amount"), F.when(k % 19 == 0, p).otherwise(p * 0.7).alias("paid_amount"),
        (k % 3 == 0).cast("int").alias("readmit_30d"), ((k % 6 == 0) | (k % 3 == 1)).cast("int").alias("readmit_90d"),
        (k * 37 % 420).alias("systolic"), (k * 53 % 300).alias("diastolic"), (k % 104).cast("double").alias("success_rate"), "o_orderstatus", "o_orderpriority",
    )


def rnd(df, names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


@query(
    "unit_tests",
    f"""WITH d AS (SELECT encounter_id, patient_id, admit_date, claim_amount, age FROM {ENC_SQL}), n AS (SELECT count(*) AS n FROM d),
         r AS (SELECT 'blank_key' AS rule, ['encounter_id'] AS columns, count(*) FILTER (WHERE encounter_id IS NULL) AS count, '' AS detail FROM d
           UNION ALL SELECT 'negative', ['claim_amount'], count(*) FILTER (WHERE claim_amount < 0), '' FROM d UNION ALL SELECT 'negative', ['age'], count(*) FILTER (WHERE age < 0), '' FROM d
           UNION ALL SELECT 'null_ref', ['patient_id'], count(*) FILTER (WHERE patient_id IS NULL), '' FROM d
           UNION ALL SELECT 'future_date', ['admit_date'], count(*) FILTER (WHERE admit_date > DATE '2000-01-01'), '0.0' FROM d)
        SELECT 'unit_tests' AS layer, rule, columns, 'fail' AS status, 'hard' AS severity, count, round(count / n, 6) AS rate, detail FROM r, n WHERE count > 0""",
)
def unit_tests(t):
    d = encounters(t).select("encounter_id", "patient_id", "admit_date", "claim_amount", "age")
    return L.unit_tests(d, "encounter_id", F.lit("2000-01-01").cast("date"))


@query(
    "confidence_score",
    """WITH b AS (SELECT count(*) AS n, stddev_pop(o_totalprice) / avg(o_totalprice) AS cv FROM orders), o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
            h AS (SELECT avg(v) FILTER (WHERE rn % 2 = 0) AS a, avg(v) FILTER (WHERE rn % 2 = 1) AS b FROM o), st AS (SELECT 1 - least(1, 2 * abs(a - b) / (abs(a) + abs(b) + 1e-9)) AS s FROM h),
            x AS (SELECT least(1, n / 200) AS c, 1.0 AS nl, CASE WHEN abs(cv) < 2 THEN 1 - least(1, abs(cv) / 2) * 0.5 ELSE 0.4 END AS sp, s, CASE WHEN n >= 100 THEN 1 ELSE 0.7 END AS sz, 1.0 AS cl FROM b, st),
            y AS (SELECT *, CAST(round(100 * (c * 0.15 + nl * 0.2 + sp * 0.15 + s * 0.15 + sz * 0.1 + cl * 0.25)) AS BIGINT) AS score FROM x)
       SELECT score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' ELSE 'C' END AS grade, 'pass' AS status, CAST(round(c * 100) AS BIGINT) AS coverage, CAST(100 AS BIGINT) AS null_score,
              CAST(round(sp * 100) AS BIGINT) AS spread, CAST(round(s * 100) AS BIGINT) AS stability, CAST(round(sz * 100) AS BIGINT) AS size, CAST(100 AS BIGINT) AS clean FROM y""",
)
def confidence_score(t):
    return L.confidence(t.orders.select("o_totalprice", "o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate", "o_orderkey", amounts=["o_totalprice"], ages=[])


@query(
    "denial_radar",
    """SELECT count(*) AS claims, count(*) FILTER (WHERE o_orderstatus = 'F') AS denied, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS rate,
       CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) > 0.15 THEN 'warn' ELSE 'pass' END AS status FROM orders""",
)
def denial_radar(t):
    return L.denial_radar(t.orders.select(F.when(F.col("o_orderstatus") == "F", "Denied").otherwise("Paid").alias("claim_status")), "claim_status")


@query("schema_fingerprint")
def schema_fingerprint(t):
    """Digest of a table's schema together with its row count."""
    d = L.schema_fingerprint(t.lineitem)
    return d.withColumn("rows", t.lineitem.agg(F.count(F.lit(1))).scalar())


@query(
    "semantic_drift",
    f"""WITH d AS {ENC_SQL}, n AS (SELECT count(*) AS n FROM d), r AS (SELECT 'age_over_130' AS rule, ['age'] AS columns, count(*) FILTER (WHERE age > 130) AS count FROM d UNION ALL SELECT 'age_negative', ['age'], count(*) FILTER (WHERE age < 0) FROM d
          UNION ALL SELECT 'percent_over_100', ['success_rate'], count(*) FILTER (WHERE success_rate > 100) FROM d)
        SELECT 'semantic_drift' AS layer, rule, columns, CASE WHEN count > 0 THEN 'fail' ELSE 'pass' END AS status, 'hard' AS severity, count, round(count / n, 6) AS rate, '' AS detail FROM r, n
        UNION ALL SELECT 'semantic_drift', 'too_many_sexes', ['sex'], 'pass', 'hard', 2, 0.0, ''""",
)
def semantic_drift(t):
    return L.semantic_drift(encounters(t), ages=["age"], sexes=["sex"], percents=["success_rate"])


@query(
    "row_count_drift",
    """WITH h AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS run_id, o_orderpriority AS "table", count(*) AS "rows" FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY run_id DESC) AS k FROM h)
       SELECT "table", max("rows") FILTER (WHERE k = 2) AS previous, max("rows") FILTER (WHERE k = 1) AS current, CAST(2 AS BIGINT) AS runs,
              CASE WHEN max("rows") FILTER (WHERE k = 2) = max("rows") FILTER (WHERE k = 1) THEN 'pass' ELSE 'fail' END AS status FROM r GROUP BY 1""",
)
def row_count_drift(t):
    h = t.orders.groupBy(F.date_trunc("year", "o_orderdate").cast("date").alias("run_id"), F.col("o_orderpriority").alias("table")).agg(F.count(F.lit(1)).alias("rows"))
    return L.row_count_drift(h)


@query(
    "correlation_watchdog",
    """SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(0.2 AS DOUBLE) AS previous, CASE WHEN abs(corr(l_quantity, l_extendedprice) - 0.2) > 0.3 THEN 'fail' ELSE 'pass' END AS status FROM lineitem
       UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6), NULL, 'pass' FROM lineitem""",
)
def correlation_watchdog(t):
    return rnd(L.correlation_watchdog(t.lineitem, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")], {("l_quantity", "l_extendedprice"): 0.2}), ["r"])


@query(
    "stated_numbers",
    """SELECT o_orderkey AS key, CAST(o_orderkey + 900000007 AS VARCHAR) AS stated FROM orders WHERE o_orderkey % 10 = 0""",
)
def stated_numbers(t):
    """Sentences citing a price, some also citing a number no fact supports."""
    k = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    text = F.concat(F.lit("The order came to "), price, F.when(k % 10 == 0, F.concat(F.lit(" and code "), (k + 900000007).cast("string"))).otherwise(""), F.lit(" in total."))
    return L.stated_numbers(t.orders.select("o_orderkey", text.alias("s")), "o_orderkey", "s", t.orders, "o_totalprice")


@query(
    "freshness_decay",
    """WITH s AS (SELECT o_orderpriority, max(o_orderdate) AS m FROM orders GROUP BY 1), a AS (SELECT o_orderpriority, date_diff('second', m, TIMESTAMP '2002-12-31') / 86400.0 AS age FROM s)
       SELECT o_orderpriority, round(age, 1) AS age_days, round(CASE WHEN age <= 180 THEN 1.0 WHEN age >= 730 THEN 0.6 ELSE 1 - 0.4 * (age - 180) / 550 END, 6) AS multiplier,
              CASE WHEN age <= 180 THEN 'fresh' WHEN age >= 730 THEN 'expired' ELSE 'stale' END AS status FROM a""",
)
def freshness_decay(t):
    return L.freshness_decay(t.orders, "o_orderdate", F.lit(dt.datetime(2002, 12, 31)), group_by=["o_orderpriority"])


@query(
    "freshness_decay_exponential",
    """WITH s AS (SELECT o_orderpriority, max(o_orderdate) AS m FROM orders GROUP BY 1), a AS (SELECT o_orderpriority, date_diff('second', m, TIMESTAMP '2002-12-31') / 86400.0 AS age FROM s)
       SELECT o_orderpriority, round(age, 1) AS age_days, round(CASE WHEN age <= 180 THEN 1.0 WHEN age >= 730 THEN 0.6 ELSE 0.6 + 0.4 * exp(-3 * (age - 180) / 550) END, 6) AS multiplier,
              CASE WHEN age <= 180 THEN 'fresh' WHEN age >= 730 THEN 'expired' ELSE 'stale' END AS status FROM a""",
)
def freshness_decay_exponential(t):
    return L.freshness_decay(t.orders, "o_orderdate", F.lit(dt.datetime(2002, 12, 31)), group_by=["o_orderpriority"], shape="exponential")


@query("reproducibility", "SELECT CAST(1 AS BIGINT) AS distinct_digests, count(DISTINCT i) AS runs, 'pass' AS status FROM (SELECT unnest([1, 2, 3]) AS i, l_orderkey FROM lineitem)")
def reproducibility(t):
    return L.reproducibility(t.lineitem)


_OUT = ["l_quantity", "l_extendedprice", "l_discount"]


def _outlier_sql(c):
    return f"""SELECT '{c}' AS "column", round(q.med, 6) AS median, round(m.mad, 6) AS mad, round(q.q1, 6) AS q1, round(q.q3, 6) AS q3,
      count(*) FILTER (WHERE {c} < q.q1 - 1.5 * (q.q3 - q.q1)) AS iqr_low, count(*) FILTER (WHERE {c} > q.q3 + 1.5 * (q.q3 - q.q1)) AS iqr_high,
      count(*) FILTER (WHERE m.mad > 0 AND abs(0.6745 * ({c} - q.med) / m.mad) > 3.5 AND {c} < q.med) AS mad_low, count(*) FILTER (WHERE m.mad > 0 AND abs(0.6745 * ({c} - q.med) / m.mad) > 3.5 AND {c} > q.med) AS mad_high
      FROM lineitem, (SELECT median({c}) AS med, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) q, (SELECT mad({c}) AS mad FROM lineitem) m GROUP BY q.med, m.mad, q.q1, q.q3"""


@query("outlier_fences", " UNION ALL ".join(_outlier_sql(c) for c in _OUT))
def outlier_fences(t):
    return rnd(L.outliers(t.lineitem, _OUT), ["median", "mad", "q1", "q3"])


def _benford_sql(table, c):
    d = f"CAST(substr(replace(CAST(CAST(abs({c}) AS DECIMAL(18, 2)) AS VARCHAR), '.', ''), 1, 1) AS INTEGER)"
    terms = " + ".join(f"power(count(*) FILTER (WHERE abs({c}) >= 1 AND {d} = {i}) - {e} * count(*) FILTER (WHERE abs({c}) >= 1), 2) / ({e} * count(*) FILTER (WHERE abs({c}) >= 1))" for i, e in enumerate((0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046), 1))
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs({c}) >= 1) AS n, NULL AS skipped, round({terms}, 4) AS chi_square, CASE WHEN {terms} > 15.51 THEN 'warn' ELSE 'pass' END AS status FROM {table}"""


@query("benford_digits", _benford_sql("orders", "o_totalprice") + " UNION ALL SELECT 'o_rank', (SELECT count(*) FROM orders WHERE o_custkey >= 1), 'bounded_name', NULL, 'idle' UNION ALL SELECT 'o_flag', (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1), 'binary_flag', NULL, 'idle'")
def benford_digits(t):
    d = t.orders.select("o_totalprice", F.col("o_custkey").alias("o_rank"), (F.col("o_orderkey") % 2).alias("o_flag"))
    return L.benford(d)


def _rule_union(rows):
    """SQL for findings: (rule, columns, violation predicate, base predicate)."""
    parts = [
        f"""SELECT '{r}' AS rule, {c} AS columns, count(*) FILTER (WHERE {v}) AS count, round(coalesce(count(*) FILTER (WHERE {v}) / nullif(count(*) FILTER (WHERE {b}), 0), 0), 6) AS rate FROM d"""
        for r, c, v, b in rows
    ]
    return "WITH d AS " + ENC_SQL + ", r AS (" + " UNION ALL ".join(parts) + ") SELECT rule, columns, CASE WHEN count > 0 THEN 'fail' ELSE 'pass' END AS status, count, rate FROM r"


@query(
    "cross_column_rules",
    _rule_union(
        [
            ("date_order", "['admit_date', 'discharge_date']", "discharge_date < admit_date", "true"),
            ("magnitude_order", "['paid_amount', 'allowed_amount']", "paid_amount > allowed_amount", "true"),
            ("sex_pregnancy", "['sex', 'pregnant']", "sex = 'Male' AND pregnant = 'yes'", "true"),
            ("minor_adult_status", "['age', 'has_retirement_account']", "age < 18 AND has_retirement_account = 'true'", "true"),
            ("los_date_mismatch", "['length_of_stay', 'admit_date', 'discharge_date']", "abs(length_of_stay - (discharge_date - admit_date)) >= 2", "true"),
            ("readmit_flag_inconsistency", "['readmit_30d', 'readmit_90d']", "readmit_30d = 1 AND readmit_90d = 0", "true"),
        ]
    ),
)
def cross_column_rules(t):
    d = encounters(t)
    rules = [r for r in K.cross_column_rules(d) if r.rule != "status_without_measure"]
    return K.run_rules(d, rules).where("count > 0").select("rule", "columns", "status", "count", "rate")


@query(
    "vital_limits",
    _rule_union(
        [
            ("systolic_limits", "['systolic']", "systolic < 40 OR systolic > 370", "systolic IS NOT NULL"),
            ("diastolic_limits", "['diastolic']", "diastolic < 15 OR diastolic > 250", "diastolic IS NOT NULL"),
            ("diastolic_above_systolic", "['systolic', 'diastolic']", "diastolic > systolic", "true"),
        ]
    ),
)
def vital_limits(t):
    d = encounters(t).select("systolic", "diastolic")
    return K.run_rules(d, K.vital_rules(d)).select("rule", "columns", "status", "count", "rate")


@query(
    "temporal_and_flag_rules",
    _rule_union(
        [
            ("admit_before_discharge", "['admit_date', 'discharge_date']", "discharge_date < admit_date", "true"),
            ("readmit_30d_implies_90d", "['readmit_30d', 'readmit_90d']", "readmit_30d = 1 AND readmit_90d = 0", "true"),
            ("long_stay_minor", "['age', 'length_of_stay']", "age < 18 AND length_of_stay > 9", "true"),
        ]
    ),
)
def temporal_and_flag_rules(t):
    """Built-in order and flag rules together with a user rule, in one scan."""
    d = encounters(t)
    rules = K.temporal_rules(d.columns) + K.flag_rules() + [K.user_rule("long_stay_minor", ["age", "length_of_stay"], "age < 18 AND length_of_stay > 9")]
    return K.run_rules(d, rules).select("rule", "columns", "status", "count", "rate")


@query(
    "bound_checks",
    """WITH d AS (SELECT CAST(o_orderkey % 104 AS DOUBLE) AS success_rate, l_discount FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
       SELECT 'rate_like_bounds' AS rule, ['success_rate'] AS columns, CASE WHEN count(*) FILTER (WHERE success_rate > 100) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) FILTER (WHERE success_rate > 100) AS count, round(count(*) FILTER (WHERE success_rate > 100) / count(*), 6) AS rate, '0..100' AS detail FROM d
       UNION ALL SELECT 'proportion_bounds', ['l_discount'], 'pass', count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1), 0.0, '0..1' FROM d""",
)
def bound_checks(t):
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_orderkey") % 104).cast("double").alias("success_rate"), "l_discount")
    return K.bound_checks(j, {"success_rate": "rate_like", "l_discount": "proportion"}).drop("layer", "severity")


@query(
    "drg_icd_mismatch",
    """WITH d AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '291' WHEN o_orderkey % 3 = 1 THEN '280' ELSE '999' END AS drg, CASE WHEN o_orderkey % 2 = 0 THEN 'I50.9' ELSE 'i21.4' END AS dx FROM orders)
       SELECT 'drg_icd_heart_failure' AS rule, count(*) FILTER (WHERE drg = '291' AND dx = 'i21.4') AS count FROM d UNION ALL SELECT 'drg_icd_acute_myocardial_infarction', count(*) FILTER (WHERE drg = '280' AND dx = 'I50.9') FROM d""",
)
def drg_icd_mismatch(t):
    k = F.col("o_orderkey")
    d = t.orders.select(F.when(k % 3 == 0, "291").when(k % 3 == 1, "280").otherwise("999").alias("drg"), F.when(k % 2 == 0, "I50.9").otherwise("i21.4").alias("dx"))
    return K.run_rules(d, K.drg_rules("drg", "dx")).where("count > 0").select("rule", "count")


MISS_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, CASE WHEN d.lang = 'en' AND d.doc_id % 3 <> 0 THEN NULL WHEN d.doc_id % 20 = 0 THEN NULL ELSE d.doc_id % 7 END AS score FROM documents d)"""


def gappy(t):
    k = F.col("doc_id")
    score = F.when((F.col("lang") == "en") & (k % 3 != 0), None).when(k % 20 == 0, None).otherwise(k % 7)
    return t.documents.select("doc_id", "lang", "source", "n_chars", score.alias("score"))


@query(
    "missingness_drivers",
    f"""WITH d AS (SELECT lang, score FROM {MISS_SQL}), g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE score IS NULL) / count(*) AS r FROM d GROUP BY 1), s AS (SELECT max(r) - min(r) AS e FROM g WHERE n >= 20)
        SELECT 'score' AS "column", count(*) FILTER (WHERE score IS NULL) AS missing_count, round(count(*) FILTER (WHERE score IS NULL) / count(*), 6) AS missing_rate, 'MAR' AS classification, 'lang' AS driver, (SELECT round(e, 3) FROM s) AS effect,
               count(*) FILTER (WHERE score IS NULL) / count(*) >= 0.3 AS mnar_caution FROM d""",
)
def missingness_drivers(t):
    return L.missingness_drivers(gappy(t).select("lang", "score"))


@query(
    "missingness_ratio",
    f"""WITH g AS (SELECT lang, count(*) FILTER (WHERE score IS NULL) / count(*) AS r FROM {MISS_SQL} GROUP BY 1)
        SELECT 'score' AS "column", 'lang' AS driver, round(max(r), 6) AS high, round(min(r), 6) AS low, round(max(r) / greatest(min(r), 0.01), 6) AS ratio FROM g""",
)
def missingness_ratio(t):
    return L.missingness_ratio(gappy(t).select("lang", "score"), ["score"])


@query(
    "bias_preflight",
    f"""WITH d AS {MISS_SQL}, o AS (SELECT count(*) FILTER (WHERE score IS NULL) / count(*) AS r FROM d), g AS (SELECT count(*) FILTER (WHERE score IS NULL) / count(*) AS r FROM d GROUP BY lang HAVING count(*) >= 5), w AS (SELECT max(r) AS worst FROM g),
         l AS (SELECT max(c) / sum(c) AS s FROM (SELECT count(*) AS c FROM d GROUP BY lang)), m AS (SELECT count(*) FILTER (WHERE score IS NULL) / (2 * count(*)) AS b FROM d)
        SELECT 'missing_cluster' AS kind, 'score by lang' AS "column", CASE WHEN worst > 0.5 THEN 'high' ELSE 'moderate' END AS severity, round(worst, 6) AS value, CASE WHEN worst > 0.5 THEN 18 ELSE 8 END AS deduction FROM w, o WHERE r >= 0.25 AND worst > r * 1.4
        UNION ALL SELECT 'class_imbalance', 'lang', CASE WHEN s >= 0.9 THEN 'high' ELSE 'moderate' END, round(s, 6), CASE WHEN s >= 0.9 THEN 20 ELSE 10 END FROM l WHERE s >= 0.7
        UNION ALL SELECT 'null_burden', '*', CASE WHEN b > 0.3 THEN 'high' ELSE 'moderate' END, round(b, 6), CASE WHEN b > 0.3 THEN 15 ELSE 8 END FROM m WHERE b > 0.15""",
)
def bias_preflight(t):
    return L.bias_preflight(gappy(t).select("lang", "score"), ["lang"])


@query("bias_score")
def bias_score(t):
    return L.bias_score(L.bias_preflight(gappy(t).select("lang", "score"), ["lang"]))


@query(
    "equity_disparity_rate",
    """WITH g AS (SELECT c_mktsegment AS "group", count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' AND (c_mktsegment <> 'BUILDING' OR o_orderkey % 3 = 0) THEN 1.0 ELSE 0 END) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
            r AS (SELECT sum(v * n) / sum(n) AS ref FROM g), x AS (SELECT *, v / ref AS ratio, v - ref AS d, greatest(v / ref, ref / v) AS size FROM g, r)
       SELECT "group", n, round(v, 6) AS value, round(ref, 6) AS reference, round(ratio, 6) AS measure, round(d, 6) AS difference, CASE WHEN size >= 1.5 OR abs(d) >= 0.05 THEN 'fail' WHEN size >= 1.25 OR abs(d) >= 0.03 THEN 'warn' ELSE 'pass' END AS status,
              CASE WHEN (size >= 1.5 OR abs(d) >= 0.05) AND (size >= 2 OR abs(d) >= 0.1) THEN 'high' WHEN size >= 1.5 OR abs(d) >= 0.05 THEN 'medium' WHEN size >= 1.25 OR abs(d) >= 0.03 THEN 'low' ELSE 'none' END AS level FROM x""",
)
def equity_disparity_rate(t):
    d = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    hit = ((F.col("o_orderstatus") == "F") & ((F.col("c_mktsegment") != "BUILDING") | (F.col("o_orderkey") % 3 == 0))).cast("int")
    return L.disparity(L.stratify(d, "c_mktsegment", hit))


@query(
    "equity_disparity_mean",
    """WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS "group", count(*) AS n, avg(c_acctbal) AS v FROM customer GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT v AS ref FROM g ORDER BY n DESC, "group" DESC LIMIT 1), x AS (SELECT *, abs(v - ref) / abs(ref) AS m FROM g, r)
       SELECT "group", n, round(v, 6) AS value, round(ref, 6) AS reference, round(m, 6) AS measure, round(v - ref, 6) AS difference, CASE WHEN m >= 0.2 THEN 'fail' WHEN m >= 0.1 THEN 'warn' ELSE 'pass' END AS status,
              CASE WHEN m >= 0.4 THEN 'high' WHEN m >= 0.2 THEN 'medium' WHEN m >= 0.1 THEN 'low' ELSE 'none' END AS level FROM x""",
)
def equity_disparity_mean(t):
    return L.disparity(L.stratify(t.customer, "c_nationkey", F.col("c_acctbal")), binary=False, reference="largest_group")


CLAIMS_SQL = """(SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'M' || CAST(o_custkey AS VARCHAR) END AS member_id, CAST(o_orderdate AS DATE) AS dos,
   CASE WHEN o_orderkey % 23 = 0 THEN '9921' ELSE '9921' || CAST(o_orderkey % 4 AS VARCHAR) END AS cpt, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'E11.9' END AS dx,
   CASE WHEN o_orderkey % 13 = 0 THEN '1234567890' ELSE '1234567893' END AS npi, CASE WHEN o_orderkey % 11 = 0 THEN 'SecondCo' END AS payer2 FROM orders)"""


def claims(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("claim_id"), F.when(k % 29 == 0, None).otherwise(F.concat(F.lit("M"), F.col("o_custkey"))).alias("member_id"), F.col("o_orderdate").cast("date").alias("dos"),
        F.when(k % 23 == 0, "9921").otherwise(F.concat(F.lit("9921"), k % 4)).alias("cpt"), F.when(k % 17 == 0, "").otherwise("E11.9").alias("dx"),
        F.when(k % 13 == 0, "1234567890").otherwise("1234567893").alias("npi"), F.when(k % 11 == 0, "SecondCo").alias("payer2"),
    )


@query(
    "claim_root_causes",
    f"""WITH d AS {CLAIMS_SQL}, x AS (SELECT *, member_id IS NULL AS e, (length(cpt) <> 5 OR dx = '') AS c, npi = '1234567890' AS p, payer2 IS NOT NULL AS b,
          coalesce(member_id IS NOT NULL AND (claim_id > min(claim_id) OVER (PARTITION BY member_id, cpt, dos)
            OR EXISTS (SELECT 1 FROM d y WHERE y.member_id = d.member_id AND y.cpt = d.cpt AND d.dos - y.dos = 1)), false) AS u FROM d),
         s AS (SELECT count(*) AS n, count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE c) AS c, count(*) FILTER (WHERE u) AS u, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE e OR c OR u OR p OR b) AS a FROM x)
        SELECT cause, lines, round(lines / n * 100, 1) AS pct, CAST(lines * 118 AS DOUBLE) AS cost FROM (SELECT n, unnest(['eligibility', 'coding', 'duplicate', 'provider', 'cob', 'any']) AS cause, unnest([e, c, u, p, b, a]) AS lines FROM s)""",
)
def claim_root_causes(t):
    return L.claim_report(L.claim_root_causes(claims(t), "claim_id", "member_id", "dos", "cpt", "dx", "npi", "payer2"))


def coded_encounters(t):
    """Encounters with the codes and the status of a claim."""
    d = encounters(t).select("encounter_id", "patient_id", "sex", "age", "admit_date", "discharge_date", "pregnant", "claim_amount", "systolic", "diastolic", "success_rate", "o_orderpriority")
    k = F.col("encounter_id")
    return d.withColumns({
        "claim_status": F.when(k % 5 == 0, "denied").otherwise("paid"), "drg": F.when(k % 3 == 0, "291").otherwise("470"),
        "icd": F.when(k % 2 == 0, "I50.9").otherwise("E11.9"), "cpt": F.when(k % 2 == 0, "58260").otherwise("58720"),
    })


def _findings(t):
    d = coded_encounters(t)
    # the table as it stood at the start of 1998 is the recorded run
    old = d.where(F.col("admit_date") < "1998-01-01")
    runs = old.agg(F.lit(1).alias("run_id"), F.count(F.lit(1)).alias("rows")).unionByName(d.agg(F.lit(2).alias("run_id"), F.count(F.lit(1)).alias("rows")))
    history = History(L.schema_fingerprint(d).first().digest, row_counts=runs.withColumn("table", F.lit("encounters")), fingerprints=fingerprint(old), snapshot=snapshot(old, "1998"))
    # a report with one sentence for each priority, of which the urgent one is out by one
    facts = d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    stated = F.col("n") + F.col("o_orderpriority").startswith("1").cast("long") * 1_000_000
    report = facts.select("o_orderpriority", F.concat(F.lit("There were "), stated.cast("string"), F.lit(" encounters.")).alias("said"))
    refs = {"patient_id": (t.customer.where("c_custkey % 10 <> 4"), "c_custkey")}
    return validate(d, "encounter_id", pack="healthcare", as_of=F.lit("2010-01-01").cast("date"), refs=refs, history=history, story=Story(report, "o_orderpriority", "said", facts, "n"))


@query("validate_all_layers")
def validate_all_layers(t):
    """Every layer over the derived encounters, under the healthcare pack."""
    return _findings(t)


_CODED_SQL = f"""(SELECT *, CASE WHEN encounter_id % 5 = 0 THEN 'denied' ELSE 'paid' END AS claim_status, CASE WHEN encounter_id % 3 = 0 THEN '291' ELSE '470' END AS drg,
   CASE WHEN encounter_id % 2 = 0 THEN 'I50.9' ELSE 'E11.9' END AS icd, CASE WHEN encounter_id % 2 = 0 THEN '58260' ELSE '58720' END AS cpt FROM {ENC_SQL})"""


def _fences_sql(column: str) -> str:
    return f"""SELECT 'outliers' AS layer, 'mad_or_fence' AS rule, '{column}' AS columns, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1)) + count(*) FILTER (WHERE x > q3 + 1.5 * (q3 - q1))
         + count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * (x - med) / mad) > 3.5) AS count
       FROM (SELECT {column} AS x, q1, med, q3, (SELECT quantile_cont(abs({column} - m), 0.5) FROM d, (SELECT quantile_cont({column}, 0.5) AS m FROM d)) AS mad
             FROM d, (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS med, quantile_cont({column}, 0.75) AS q3 FROM d))"""


@query(
    "validation_counts",
    f"""WITH d AS MATERIALIZED (SELECT * FROM {_CODED_SQL}), both_codes AS (
          SELECT 'admit_date' AS day_column, patient_id, admit_date AS day FROM d WHERE patient_id IS NOT NULL GROUP BY patient_id, admit_date HAVING count(DISTINCT cpt) = 2
          UNION ALL SELECT 'discharge_date', patient_id, discharge_date FROM d WHERE patient_id IS NOT NULL GROUP BY patient_id, discharge_date HAVING count(DISTINCT cpt) = 2),
        r AS (SELECT 'unit_tests' AS layer, 'negative' AS rule, 'claim_amount' AS columns, count(*) AS count FROM d WHERE claim_amount < 0
          UNION ALL SELECT 'unit_tests', 'negative', 'age', count(*) FROM d WHERE age < 0
          UNION ALL SELECT 'unit_tests', 'null_ref', 'patient_id', count(*) FROM d WHERE patient_id IS NULL
          UNION ALL SELECT 'semantic_drift', 'age_over_130', 'age', count(*) FROM d WHERE age > 130
          UNION ALL SELECT 'semantic_drift', 'age_negative', 'age', count(*) FROM d WHERE age < 0
          UNION ALL SELECT 'semantic_drift', 'percent_over_100', 'success_rate', count(*) FROM d WHERE success_rate > 100
          UNION ALL SELECT 'bounds', 'rate_like_bounds', 'success_rate', count(*) FROM d WHERE success_rate > 100 OR success_rate < 0
          UNION ALL SELECT 'denial_radar', 'denied_share', 'claim_status', count(*) FROM d WHERE claim_status = 'denied'
          UNION ALL SELECT 'drg_icd', 'drg_icd_heart_failure', 'drg,icd', count(*) FROM d WHERE drg = '291' AND icd <> 'I50.9'
          UNION ALL SELECT 'drg_icd', 'drg_icd_joint_replacement', 'drg,icd', count(*) FROM d WHERE drg = '470'
          UNION ALL SELECT 'code_conflict', '58260+58720', 'patient_id,' || day_column || ',cpt', count(*) FROM both_codes GROUP BY day_column
          UNION ALL SELECT 'foreign_key', 'patient_id->c_custkey', 'patient_id', count(*) FROM d WHERE patient_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 4)
          UNION ALL SELECT 'row_counts', 'history', '', count(*) FROM d WHERE admit_date >= DATE '1998-01-01'
          UNION ALL SELECT 'stated_numbers', 'unsupported', 'said', count(DISTINCT o_orderpriority) FROM d WHERE starts_with(o_orderpriority, '1')
          UNION ALL SELECT 'temporal', 'admit_before_discharge', 'admit_date,discharge_date', count(*) FROM d WHERE discharge_date < admit_date
          UNION ALL SELECT 'vitals', 'diastolic_above_systolic', 'systolic,diastolic', count(*) FROM d WHERE diastolic > systolic
          UNION ALL {_fences_sql('claim_amount')} UNION ALL {_fences_sql('age')}
          UNION ALL SELECT 'categorical', 'spelling_variants', 'cpt', count(DISTINCT cpt) FROM d)
        SELECT layer, rule, columns, count FROM r WHERE count > 0""",
)
def validation_counts(t):
    """What the layers of ``validate_all_layers`` count, where they find something."""
    names = "unit_tests semantic_drift bounds denial_radar drg_icd code_conflict foreign_key row_counts stated_numbers temporal vitals outliers categorical".split()
    f = _findings(t).where(F.col("layer").isin(*names) & F.col("status").isin("warn", "fail") & ~F.col("rule").like("%\\_limits"))
    return f.select("layer", "rule", F.array_join("columns", ",").alias("columns"), "count")


@query("calibrated_grades")
def calibrated_grades(t):
    return L.calibrated_grades(_findings(t))


@query("readiness_verdict")
def readiness_verdict(t):
    return L.readiness_verdict(_findings(t))


@query("cat_scorecard")
def cat_scorecard(t):
    return L.cat_scorecard(encounters(t), _findings(t), F.lit(60.0))


@query(
    "domain_pack_outliers",
    """SELECT 'outliers' AS layer, ['l_extendedprice'] AS columns, 'pass' AS status, true AS reinterpreted, count(*) FILTER (WHERE l_extendedprice > q.q3 + 1.5 * (q.q3 - q.q1) OR l_extendedprice < q.q1 - 1.5 * (q.q3 - q.q1)) AS count
       FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_extendedprice * 10 ELSE l_extendedprice END AS l_extendedprice FROM lineitem) x, (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_extendedprice * 10 ELSE l_extendedprice END AS p FROM lineitem)) q""",
)
def domain_pack_outliers(t):
    """Outliers in a price column read as expected swings under the retail pack."""
    from plumbline.plans.validate import as_findings

    x = t.lineitem.select(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"))
    o = L.outliers(x)
    f = as_findings(o, "outliers", "fence", F.col("column"), "warn", F.col("iqr_low") + F.col("iqr_high"))
    return L.apply_pack(f, "retail").select("layer", "columns", "status", "reinterpreted", "count")


@query(
    "outlier_concentration",
    """WITH x AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_extendedprice * 10 ELSE l_extendedprice END AS v, l_returnflag AS f, l_linestatus AS s FROM lineitem), m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM x),
            o AS (SELECT *, abs((v - mu) / sd) > 2.5 AS o FROM x, m), n AS (SELECT count(*) FILTER (WHERE o) AS n FROM o), g AS (SELECT 'l_returnflag' AS category, f AS "group", count(*) FILTER (WHERE o) AS outliers, count(*) AS "rows" FROM o GROUP BY 2 UNION ALL SELECT 'l_linestatus', s, count(*) FILTER (WHERE o), count(*) FROM o GROUP BY 2)
       SELECT category, "group", outliers, "rows", round(outliers / n, 6) AS share FROM g, n WHERE outliers / n >= 0.5""",
)
def outlier_concentration(t):
    v = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice"))
    return L.outlier_concentration(t.lineitem.withColumn("v", v), "v", ["l_returnflag", "l_linestatus"])


@query(
    "column_health",
    """WITH f AS (SELECT c_custkey AS row_id, 'acctbal' AS "column", CASE WHEN c_acctbal < -900 THEN 'error' ELSE 'warning' END AS severity FROM customer WHERE c_acctbal < 0)
       SELECT "column", count(DISTINCT row_id) FILTER (WHERE severity = 'warning') AS warnings, count(DISTINCT row_id) FILTER (WHERE severity = 'error') AS errors, CAST(0 AS BIGINT) AS criticals,
              CAST(round(greatest(0, 1 - 0.1 * count(DISTINCT row_id) FILTER (WHERE severity = 'warning') - 0.2 * count(DISTINCT row_id) FILTER (WHERE severity = 'error')), 3) AS DOUBLE) AS score FROM f GROUP BY 1""",
)
def column_health(t):
    f = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("row_id"), F.lit("acctbal").alias("column"), F.when(F.col("c_acctbal") < -900, "error").otherwise("warning").alias("severity"))
    return L.column_health(f.unionByName(f))


@query(
    "row_severity",
    """SELECT c_custkey AS row_id, CASE WHEN c_acctbal < -500 THEN 'error' ELSE 'warning' END AS severity FROM customer WHERE c_acctbal < 0""",
)
def row_severity(t):
    f = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("row_id"), F.lit("a").alias("column"), F.lit("warning").alias("severity"))
    return L.row_severity(f.unionByName(f.join(t.customer.where("c_acctbal < -500"), F.col("row_id") == F.col("c_custkey"), "left_semi").withColumn("severity", F.lit("error"))))


@query(
    "layer_priority",
    """WITH f AS (SELECT event_type AS layer, value > 60 AS accepted, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events),
            g AS (SELECT layer, count(*) AS actions, sum(CASE WHEN accepted THEN power(0.97, n - pos) ELSE 0 END) AS a, sum(CASE WHEN NOT accepted THEN power(0.97, n - pos) ELSE 0 END) AS d FROM f GROUP BY 1)
       SELECT layer, actions, round((a + 1) / (a + d + 2), 6) AS score, CASE WHEN (a + 1) / (a + d + 2) >= 0.6 THEN 'promote' WHEN (a + 1) / (a + d + 2) <= 0.4 THEN 'sink' ELSE 'neutral' END AS tier FROM g""",
)
def layer_priority(t):
    f = t.events.select(F.col("event_type").alias("layer"), (F.col("value") > 60).alias("accepted"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return L.layer_priority(f)


@query(
    "traffic_lights",
    f"""WITH d AS (SELECT doc_id, lang, score, n_chars FROM {MISS_SQL}), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE score IS NULL) AS e FROM d)
        SELECT 'score' AS "column", e AS empty, CAST(0 AS BIGINT) AS negatives, round(e / n, 6) AS empty_rate, CASE WHEN e / n > 0.2 THEN 'red' WHEN e / n > 0.05 THEN 'amber' ELSE 'green' END AS light FROM s
        UNION ALL SELECT c, 0, 0, 0.0, 'green' FROM (SELECT unnest(['doc_id', 'lang', 'n_chars']) AS c)""",
)
def traffic_lights(t):
    return L.traffic_lights(gappy(t).select("doc_id", "lang", "score", "n_chars"))


@query("row_lights", f"SELECT doc_id, true AS error, false AS warning FROM {MISS_SQL} WHERE score IS NULL")
def row_lights(t):
    return L.row_lights(gappy(t), "doc_id", {"score": "red", "lang": "green"})
