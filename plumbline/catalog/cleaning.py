"""Issue scans, fixes, imputation, format repair, reshaping, defect injection."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import clean as C
from plumbline.operators import reshape as R

# A customer table with planted flaws, derived from the whole customer table on both engines.
DIRTY_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS price_amount, c_nationkey FROM customer)"""


def dirty(t):
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        F.when(k % 9 == 0, None).when(k % 5 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 11 == 0, None).otherwise(F.col("c_acctbal")).alias("price_amount"),
        "c_nationkey",
    )


@query(
    "issue_scan",
    f"""WITH d AS {DIRTY_SQL}, n AS (SELECT count(*) AS n FROM d), i AS (
        SELECT 'nulls' AS issue, 'segment' AS "column", count(*) FILTER (WHERE segment IS NULL) AS count, ['drop_rows', 'fill_mode'] AS fixes FROM d
        UNION ALL SELECT 'nulls', 'price_amount', count(*) FILTER (WHERE price_amount IS NULL), ['drop_rows', 'fill_zero', 'fill_mean', 'fill_mode'] FROM d
        UNION ALL SELECT 'whitespace', 'segment', count(*) FILTER (WHERE segment <> trim(segment)), ['trim'] FROM d
        UNION ALL SELECT 'negative', 'price_amount', count(*) FILTER (WHERE price_amount < 0), ['drop_rows', 'abs_value', 'null_out'] FROM d)
      SELECT issue, "column", count, round(count / n * 100, 1) AS pct, fixes FROM i, n WHERE count > 0""",
)
def issue_scan(t):
    return C.scan_issues(dirty(t), near_duplicates=False)


@query(
    "issue_scan_near_duplicates",
    """WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN replace(v, 'a', 'e') WHEN p_partkey % 13 = 0 THEN NULL ELSE v END AS item_name
                  FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS v FROM part)),
            f AS (SELECT item_name AS v, count(*) AS n FROM d WHERE item_name IS NOT NULL GROUP BY 1),
            p AS (SELECT sum(a.n * b.n) AS c FROM f a JOIN f b ON a.v < b.v WHERE 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)) > 0.9),
            i AS (SELECT 'nulls' AS issue, 'item_name' AS "column", count(*) FILTER (WHERE item_name IS NULL) AS count,
                         round(count(*) FILTER (WHERE item_name IS NULL) / count(*) * 100, 1) AS pct, ['drop_rows', 'fill_mode'] AS fixes FROM d
                  UNION ALL SELECT 'fuzzy_duplicates', 'item_name', CAST(coalesce(c, 0) AS BIGINT), NULL, CAST([] AS VARCHAR[]) FROM p)
       SELECT * FROM i WHERE count > 0""",
)
def issue_scan_near_duplicates(t):
    """The whole part table, some names misspelt, some missing."""
    k, v = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_brand", "p_type")
    d = t.part.select("p_partkey", F.when(k % 7 == 0, F.replace(v, F.lit("a"), F.lit("e"))).when(k % 13 == 0, None).otherwise(v).alias("item_name"))
    return C.scan_issues(d, threshold=0.9, metric="levenshtein")


@query("fix_fill_mean", f"WITH d AS {DIRTY_SQL} SELECT c_custkey, round(coalesce(price_amount, (SELECT avg(price_amount) FROM d)), 4) AS price_amount FROM d")
def fix_fill_mean(t):
    d, _ = C.apply_fix(dirty(t), "nulls", "price_amount", "fill_mean")
    return d.select("c_custkey", F.round("price_amount", 4).alias("price_amount"))


@query(
    "fix_fill_mode_trim",
    f"""WITH d AS {DIRTY_SQL}, m AS (SELECT trim(segment) AS v FROM d WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT coalesce(trim(segment), (SELECT v FROM m)) AS segment, count(*) AS n FROM d GROUP BY 1""",
)
def fix_fill_mode_trim(t):
    d, _ = C.apply_fix(dirty(t), "whitespace", "segment", "trim")
    d, _ = C.apply_fix(d, "nulls", "segment", "fill_mode")
    return d.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fix_drop_abs_nullout",
    f"""WITH d AS {DIRTY_SQL}
        SELECT 'drop_rows' AS fix, count(*) AS "rows", round(sum(price_amount), 2) AS total FROM d WHERE NOT coalesce(price_amount < 0, false)
        UNION ALL SELECT 'abs_value', count(*), round(sum(abs(price_amount)), 2) FROM d
        UNION ALL SELECT 'null_out', count(*), round(sum(CASE WHEN price_amount < 0 THEN NULL ELSE price_amount END), 2) FROM d
        UNION ALL SELECT 'fill_zero', count(*), round(sum(coalesce(price_amount, 0)), 2) FROM d""",
)
def fix_drop_abs_nullout(t):
    out = None
    for issue, fix in (("negative", "drop_rows"), ("negative", "abs_value"), ("negative", "null_out"), ("nulls", "fill_zero")):
        d, _ = C.apply_fix(dirty(t), issue, "price_amount", fix)
        row = d.agg(F.lit(fix).alias("fix"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("price_amount"), 2).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "fix_audit_rows",
    f"""WITH d AS {DIRTY_SQL} SELECT 'nulls' AS issue, 'price_amount' AS "column", 'fill_zero' AS fix, count(*) FILTER (WHERE price_amount IS NULL) AS rows_affected FROM d
        UNION ALL SELECT 'duplicates', NULL, 'dedupe', (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM customer GROUP BY c_nationkey, c_mktsegment)) """,
)
def fix_audit_rows(t):
    _, a = C.apply_fix(dirty(t), "nulls", "price_amount", "fill_zero")
    _, b = C.apply_fix(t.customer.select("c_nationkey", "c_mktsegment"), "duplicates", None, "dedupe")
    return a.unionByName(b)


@query("fix_dedupe", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def fix_dedupe(t):
    d, _ = C.apply_fix(t.customer.select("c_nationkey", "c_mktsegment"), "duplicates", None, "dedupe")
    return d


def _mean_sql(c: str) -> str:
    """SQL of an exact mean of money: whole cents, the sixth digit rounded half away from zero."""
    s = f"sum(CAST(round({c} * 100) AS HUGEINT))"
    return f"CAST(sign({s}) * CAST((abs({s}) * 20000 + count({c})) // (2 * count({c})) AS BIGINT) / 1000000.0 AS DOUBLE)"


@query(
    "impute_group_mean",
    f"""WITH d AS {DIRTY_SQL}, g AS (SELECT segment, c_nationkey, {_mean_sql('price_amount')} AS m FROM d WHERE price_amount IS NOT NULL GROUP BY 1, 2)
        SELECT d.c_custkey, coalesce(price_amount, g.m, (SELECT {_mean_sql('price_amount')} FROM d)) AS price_amount_imputed
        FROM d LEFT JOIN g ON d.segment IS NOT DISTINCT FROM g.segment AND d.c_nationkey IS NOT DISTINCT FROM g.c_nationkey""",
)
def impute_group_mean(t):
    exact = dirty(t).withColumn("price_amount", F.col("price_amount").cast("decimal(14,2)"))
    d = C.impute_group_mean(exact, "price_amount", ["segment", "c_nationkey"])
    return d.select("c_custkey", F.col("price_amount_imputed").cast("double").alias("price_amount_imputed"))


@query(
    "impute_preview",
    f"""WITH d AS {DIRTY_SQL} SELECT count(*) AS total_rows, count(*) FILTER (WHERE price_amount IS NULL) AS null_count,
        count(*) FILTER (WHERE price_amount IS NULL) AS would_fill, CAST(0 AS BIGINT) AS remaining FROM d""",
)
def impute_preview(t):
    return C.impute_preview(dirty(t), "price_amount", ["segment"])


FORMATS_SQL = """(SELECT o_orderkey, '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.50' AS amount,
   CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dt,
   CASE WHEN o_orderkey % 13 = 0 THEN ' N/A' WHEN o_orderkey % 17 = 0 THEN 'Unknown' ELSE o_orderpriority END AS note FROM orders)"""


def formats(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(".50")).alias("amount"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dt"),
        F.when(k % 13 == 0, " N/A").when(k % 17 == 0, "Unknown").otherwise(F.col("o_orderpriority")).alias("note"),
    )


@query(
    "format_scan",
    f"""WITH d AS {FORMATS_SQL} SELECT 'amount' AS "column", 'currency_text' AS issue, count(*) AS count FROM d
        UNION ALL SELECT 'dt', 'mixed_dates', count(*) FROM d
        UNION ALL SELECT 'note', 'fake_null', count(*) FILTER (WHERE lower(trim(note)) IN ('n/a', 'unknown')) FROM d""",
)
def format_scan(t):
    return C.scan_formats(formats(t))


@query(
    "format_fixes",
    f"""WITH d AS {FORMATS_SQL} SELECT o_orderkey, CAST(replace(amount, '$', '') AS DOUBLE) AS amount_num,
        CAST(coalesce(try_strptime(dt, '%m/%d/%Y'), try_strptime(dt, '%Y-%m-%d'))::DATE AS VARCHAR) AS dt_date,
        CASE WHEN lower(trim(note)) IN ('n/a', 'unknown') THEN NULL ELSE note END AS note FROM d""",
)
def format_fixes(t):
    d = C.fix_fake_nulls(C.fix_dates(C.fix_currency(formats(t), "amount"), "dt"), "note")
    return d.select("o_orderkey", "amount_num", F.col("dt_date").cast("string").alias("dt_date"), "note")


@query(
    "uncertain_imputations",
    f"""WITH d AS {DIRTY_SQL}, s AS (SELECT count(*) FILTER (WHERE price_amount IS NULL) AS pn, least(1.0, abs(stddev_pop(price_amount) / avg(price_amount)) / 2) AS pu, count(*) FILTER (WHERE segment IS NULL) AS sn FROM d),
        f AS (SELECT count(*) AS c FROM d WHERE segment IS NOT NULL GROUP BY segment ORDER BY 1 DESC LIMIT 2)
        SELECT 'price_amount' AS "column", pn AS nulls, round(pu, 4) AS uncertainty FROM s
        UNION ALL SELECT 'segment', sn, round(1 - ((SELECT max(c) FROM f) - (SELECT min(c) FROM f)) / (SELECT sum(c) FROM f), 4) FROM s""",
)
def uncertain_imputations(t):
    return C.uncertain_imputations(dirty(t))


@query(
    "fix_confidence_material",
    f"""WITH d AS {DIRTY_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE price_amount IS NULL) AS pn, count(*) FILTER (WHERE segment <> trim(segment)) AS w, stddev_pop(price_amount) / avg(price_amount) AS cv FROM d)
        SELECT 'nulls' AS issue, 'price_amount' AS "column", 'fill_mean' AS fix, round(pn / n * 100, 1) AS pct,
               CAST(CASE WHEN cv < 0.25 THEN 80 WHEN cv < 0.75 THEN 60 ELSE 45 END AS BIGINT) AS score, CASE WHEN cv < 0.25 THEN 'high' WHEN cv < 0.75 THEN 'medium' ELSE 'low' END AS confidence FROM s
        UNION ALL SELECT 'nulls', 'price_amount', 'fill_zero', round(pn / n * 100, 1), 45, 'low' FROM s
        UNION ALL SELECT 'whitespace', 'segment', 'trim', round(w / n * 100, 1), 96, 'high' FROM s""",
)
def fix_confidence_material(t):
    d = dirty(t)
    stats = d.agg(F.stddev_pop("price_amount") / F.avg("price_amount")).scalar()
    i = C.scan_issues(d, duplicates=False, near_duplicates=False).select("issue", "column", "pct", F.explode("fixes").alias("fix"))
    i = i.where(F.col("fix").isin("fill_mean", "fill_zero", "trim")).withColumns({"cv": stats, "mode_share": F.lit(None).cast("double")})
    return C.fix_confidence(C.material_issues(i, 1.0)).select("issue", "column", "fix", "pct", "score", "confidence")


@query(
    "unpivot_lines",
    """SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE value)""",
)
def unpivot_lines(t):
    return R.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(
    "unpivot_text_as_number",
    """WITH d AS (SELECT o_orderkey, '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS q1, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS VARCHAR) || '%' END AS q2 FROM orders)
       SELECT name, count(*) AS n, sum(value) AS total FROM (SELECT 'q1' AS name, TRY_CAST(replace(q1, '$', '') AS DOUBLE) AS value FROM d UNION ALL SELECT 'q2', TRY_CAST(replace(q2, '%', '') AS DOUBLE) FROM d) WHERE value IS NOT NULL GROUP BY 1""",
)
def unpivot_text_as_number(t):
    d = t.orders.select(
        "o_orderkey", F.concat(F.lit("$"), F.floor("o_totalprice").cast("string")).alias("q1"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("%"))).alias("q2"),
    )
    u = R.unpivot(d, ["o_orderkey"], ["q1", "q2"], value_as="double")
    return u.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "grid_repair",
    """SELECT o_orderkey + 4 AS row_id, o_custkey AS "Customer / Id", o_orderstatus AS "Order / Status", floor(o_totalprice) + 0.5 AS "Order / Price",
       strftime(o_orderdate, '%Y-%m-%d') AS "Order / Date" FROM orders""",
)
def grid_repair(t):
    """A messy export of the whole orders table: title, blank line, two header rows, empty column, totals."""
    n = t.orders.agg(F.max("o_orderkey")).scalar()
    cells = lambda *c: F.array(*[F.lit(x).cast("string") if not hasattr(x, "cast") else x for x in c])
    body = t.orders.select(
        (F.col("o_orderkey") + 4).alias("row_id"),
        cells(F.concat(F.lit(" "), F.col("o_custkey").cast("string")), F.col("o_orderstatus"), F.lit(""),
              F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5")), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells"),
    )
    spark = t.spark
    head = spark.createDataFrame(
        [(0, ["Orders export", None, None, None, None]), (1, [None] * 5), (2, ["Customer", "Order", None, "Order", "Order"]), (3, ["Id", "Status", None, "Price", "Date"])],
        "row_id long, cells array<string>",
    )
    foot = t.orders.agg((n + 6).alias("row_id"), cells("Grand total", "", "", "1", "").alias("cells")).select("row_id", "cells")
    blank = t.orders.agg((n + 5).alias("row_id"), cells("", "", "", "", "").alias("cells")).select("row_id", "cells")
    grid = head.unionByName(body).unionByName(blank).unionByName(foot)
    return R.apply_grid_repair(grid, R.plan_grid_repair(grid))


@query("inject_defects_manifest")
def inject_defects_manifest(t):
    _, m = C.inject_defects(t.orders, "o_orderkey", {"o_custkey": 0.05}, {"o_totalprice": 0.02}, {"o_orderstatus": 0.1}, 0.03, seed=9)
    return m


@query("inject_defects_recall")
def inject_defects_recall(t):
    """Planted defects against what the scans find on the damaged table."""
    d, m = C.inject_defects(t.orders, "o_orderkey", {"o_custkey": 0.05}, {"o_totalprice": 0.02}, {"o_orderstatus": 0.1}, 0.03, seed=9)
    once = d.dropDuplicates()
    found = once.agg(
        F.count_if(F.col("o_custkey").isNull()).alias("missing"), F.count_if(F.col("o_totalprice") > 1e6).alias("outlier"),
        F.count_if(F.col("o_orderstatus").endswith("_drift")).alias("drift"),
    ).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in ("missing", "outlier", "drift")])).alias("r")).select("r.*")
    dup = d.agg(F.count(F.lit(1)).alias("a")).select(F.lit("duplicate").alias("kind"), (F.col("a") - t.orders.agg(F.count(F.lit(1))).scalar()).alias("found"))
    return m.join(found.unionByName(dup), "kind").select("kind", "count", "found")
