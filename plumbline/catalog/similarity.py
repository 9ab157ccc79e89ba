"""Similar values, clusters, convergence, vector top-k and text functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import text as X
from plumbline.operators import fuzzy as Z
from plumbline.operators import vector_index as I
from plumbline.operators import vectors as V
from plumbline.session import spread

def part_names(t):
    return t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"))


@query("fuzzy_duplicate_names")
def fuzzy_duplicate_names(t):
    """Larger of edit and Jaro-Winkler similarity; no SQL engine here scores half transpositions the same way."""
    return Z.fuzzy_duplicates(part_names(t), "name")


@query(
    "fuzzy_duplicates_edit_distance",
    """WITH f AS (SELECT p_name || ' ' || p_brand || ' ' || p_type AS name, count(*) AS n FROM part GROUP BY 1),
            p AS (SELECT a.name AS value_a, b.name AS value_b, a.n AS rows_a, b.n AS rows_b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS s
                  FROM f a JOIN f b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 5)
       SELECT value_a, value_b, rows_a, rows_b, round(s, 3) AS similarity FROM p WHERE s > 0.9""",
)
def fuzzy_duplicates_edit_distance(t):
    d = t.part.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    return Z.fuzzy_duplicates(d, "name", 0.9, metric="levenshtein")


@query(
    "category_clusters",
    """WITH v AS (SELECT p_type || CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN 'S' WHEN p_partkey % 10 = 2 THEN ' ' ELSE '' END AS value, count(*) AS count FROM part GROUP BY 1),
            g AS (SELECT *, regexp_replace(trim(value), 'S$', '') AS grp FROM v)
       SELECT first_value(value) OVER (PARTITION BY grp ORDER BY count DESC, value) AS canonical, value, count,
              value <> first_value(value) OVER (PARTITION BY grp ORDER BY count DESC, value) AS "merge" FROM g""",
)
def category_clusters(t):
    """Part types with planted spelling variants (trailing S or space)."""
    k = F.col("p_partkey") % 10
    v = F.concat(F.col("p_type"), F.when(k == 1, "S").when(k == 2, " ").otherwise(""))
    return Z.category_clusters(t.part.select(v.alias("kind")), "kind")


@query(
    "apply_category_merges",
    """SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1""",
)
def apply_category_merges(t):
    k = F.col("p_partkey") % 10
    v = F.concat(F.col("p_type"), F.when(k == 1, "S").when(k == 2, " ").otherwise(""))
    d = t.part.select(v.alias("kind"))
    merged = Z.apply_merges(d, "kind", Z.category_clusters(d, "kind"))
    return merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _sources(t):
    roster = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.round("o_totalprice", 1).alias("paid"))
    clinic = t.orders.where(F.col("o_orderkey") % 3 != 0).select(
        F.col("o_orderkey").cast("string").alias("claim_id"), F.concat(F.lit("P"), F.col("o_orderkey")).alias("patient_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_of_service"),
        F.when(F.col("o_orderkey") % 5 == 0, F.round("o_totalprice", 1) + 1).otherwise(F.round("o_totalprice", 1)).alias("paid"),
    )
    payer = t.orders.where(F.col("o_orderkey") % 2 == 0).select(
        F.concat(F.lit("p"), F.col("o_orderkey")).alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_of_service"),
        F.when(F.col("o_orderkey") % 7 == 0, F.round("o_totalprice", 1) + 2).otherwise(F.round("o_totalprice", 1)).alias("paid"),
    )
    return [
        Z.Source("A", roster, (("claim_id",),), 0.9),
        Z.Source("B", clinic, (("claim_id",), ("patient_id", "date_of_service")), 0.7),
        Z.Source("C", payer, (("date_of_service", "patient_id"),), 0.65),
    ]


@query(
    "source_convergence",
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS b, o_orderkey % 2 = 0 AS c, o_orderkey % 5 = 0 AS b5, o_orderkey % 7 = 0 AS c7 FROM orders),
            y AS (SELECT *, b AND c AS linked FROM x),
            cl AS (SELECT CASE WHEN linked THEN 3 WHEN b THEN 2 ELSE 1 END AS coverage, (b AND b5) OR (linked AND c7) AS conflict, linked AND c7 AND NOT b5 AND FALSE AS esc FROM y
                   UNION ALL SELECT 1, FALSE, FALSE FROM y WHERE c AND NOT b)
       SELECT count(*) FILTER (WHERE coverage >= 2) AS joined_clusters, CAST(0 AS BIGINT) AS needs_human, count(*) FILTER (WHERE coverage >= 2 AND conflict) AS auto_resolved FROM cl""",
)
def source_convergence(t):
    """Three sources linked by two different keys; A and C meet only through B."""
    clusters, _ = Z.converge(_sources(t))
    return Z.convergence_summary(clusters)


@query(
    "reconcile_claims",
    """WITH s AS (SELECT o_orderkey AS entity, o_orderkey % 4 AS m FROM orders)
       SELECT CAST(entity AS VARCHAR) AS entity, 'status' AS field, CASE WHEN m = 0 THEN 'confidence' WHEN m = 1 THEN 'source trust' WHEN m = 2 THEN 'single claim' ELSE 'source trust' END AS decided_by,
              CASE WHEN m = 0 THEN 'b' ELSE 'a' END AS source, CASE WHEN m = 0 THEN 'Y' ELSE 'X' END AS value, CASE WHEN m = 0 THEN CAST(0.3 AS DOUBLE) END AS margin FROM s""",
)
def reconcile_claims(t):
    m = F.col("o_orderkey") % 4
    e = F.col("o_orderkey").cast("string").alias("entity")
    a = t.orders.select(e, F.lit("status").alias("field"), F.lit("X").alias("value"), F.lit("a").alias("source"), F.when(m == 3, None).otherwise(F.lit(0.6)).alias("confidence"))
    b = t.orders.where(m != 2).select(e, F.lit("status").alias("field"), F.lit("Y").alias("value"), F.lit("b").alias("source"), F.when(m == 0, 0.9).otherwise(0.62).alias("confidence"))
    return Z.reconcile_claims(a.unionByName(b), {"a": 0.9, "b": 0.5})


@query(
    "vector_top_k",
    """WITH q AS (SELECT label AS query_id, embedding AS qv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1),
            s AS (SELECT query_id, vec_id, list_cosine_similarity(list_transform(qv, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS score FROM q, embeddings)
       SELECT query_id, vec_id, round(score, 6) AS score, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rk FROM s) WHERE rk <= 5""",
)
def vector_top_k(t):
    """Nearest vectors for one query vector per label, over the whole table."""
    q = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv")).select(F.col("label").alias("query_id"), "qv")
    return V.top_k(t.embeddings, "vec_id", "embedding", q, "query_id", "qv", 5).withColumn("score", F.round("score", 6))


@query(
    "vector_top_k_indexed",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e AS q, e WHERE q.vec_id % 50 = 0)
       SELECT query_id, vec_id, round(score, 6) AS score, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rk FROM s) WHERE rk <= 10""",
)
def vector_top_k_indexed(t):
    """Nearest ten for every vector whose id is divisible by 50, among all, through the index."""
    q = t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return I.indexed_top_k(t.embeddings, "vec_id", "embedding", q, "query_id", "qv", 10).withColumn("score", F.round("score", 6))


@query(
    "chunk_documents",
    r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(text) <> ''),
            c AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 200) / 180.0) AS BIGINT)))) AS chunk FROM w)
       SELECT doc_id, chunk, CAST(len(w[chunk * 180 + 1 : chunk * 180 + 200]) AS BIGINT) AS words, md5(array_to_string(w[chunk * 180 + 1 : chunk * 180 + 200], ' ')) AS digest FROM c""",
)
def chunk_documents(t):
    d = spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(X.chunk_words(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.chunk").alias("chunk"), F.col("c.words").alias("words"), F.md5("c.text").alias("digest"))


@query(
    "similarity_functions",
    """WITH p AS (SELECT c_custkey, c_name AS a, 'Customer ' || c_mktsegment AS b FROM customer)
       SELECT c_custkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS lev FROM p""",
)
def similarity_functions(t):
    b = F.concat(F.lit("Customer "), F.col("c_mktsegment"))
    return t.customer.select("c_custkey", F.round(X.levenshtein_similarity(F.col("c_name"), b), 6).alias("lev"))


@query(
    "bigram_dice",
    """WITH v AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS x, replace(lower(p_type || ' ' || p_name), ' ', '') AS y FROM part),
            gx AS (SELECT p_partkey, substr(x, i, 2) AS g, count(*) AS c FROM (SELECT p_partkey, x, unnest(generate_series(1, length(x) - 1)) AS i FROM v) GROUP BY 1, 2),
            gy AS (SELECT p_partkey, substr(y, i, 2) AS g, count(*) AS c FROM (SELECT p_partkey, y, unnest(generate_series(1, length(y) - 1)) AS i FROM v) GROUP BY 1, 2),
            o AS (SELECT p_partkey, sum(least(gx.c, gy.c)) AS o FROM gx JOIN gy USING (p_partkey, g) GROUP BY 1)
       SELECT p_partkey, round(2 * coalesce(o, 0) / (length(x) - 1 + length(y) - 1), 6) AS dice FROM v LEFT JOIN o USING (p_partkey)""",
)
def bigram_dice(t):
    d = X.bigram_dice(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"))
    return spread(t.part.select("p_partkey", "p_name", "p_type")).select("p_partkey", F.round(d, 6).alias("dice"))


@query(
    "abbreviation_expansion",
    """SELECT CASE c_nationkey % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'United States' WHEN 2 THEN 'New York' END AS expanded, count(*) AS n FROM customer GROUP BY 1""",
)
def abbreviation_expansion(t):
    k = F.col("c_nationkey") % 4
    code = F.when(k == 0, " fra ").when(k == 1, "USA").when(k == 2, "ny").otherwise("zz")
    return t.customer.select(X.expand_abbreviation(code).alias("expanded")).groupBy("expanded").agg(F.count(F.lit(1)).alias("n"))


@query(
    "code_shape_checks",
    """WITH d AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS cpt FROM orders)
       SELECT k, CASE WHEN k % 3 = 0 THEN false ELSE true END AS cpt_ok, CASE WHEN k % 2 = 0 THEN true ELSE false END AS icd_ok FROM d""",
)
def code_shape_checks(t):
    k = F.col("o_orderkey")
    cpt = F.lpad((k % 100000).cast("string"), 5, "0")
    cpt = F.when(k % 3 == 0, F.concat(cpt, F.lit("Z9"))).otherwise(cpt)
    icd = F.when(k % 2 == 0, F.concat(F.lit("E11."), (k % 10).cast("string"))).otherwise(F.lit("U99"))
    return t.orders.select(k.alias("k"), X.cpt_shaped(cpt).alias("cpt_ok"), X.icd10_shaped(icd).alias("icd_ok"))


@query(
    "npi_check_digit",
    """WITH d AS (SELECT c_custkey, lpad(CAST(1000000000 + c_custkey * 7 AS VARCHAR), 10, '0') AS npi FROM customer),
            e AS (SELECT c_custkey, npi, i, CAST(substr(npi, CAST(i AS INTEGER), 1) AS INTEGER) AS g FROM (SELECT *, unnest(generate_series(1, 10)) AS i FROM d)),
            s AS (SELECT c_custkey, 24 + sum(CASE WHEN i % 2 = 1 THEN CASE WHEN g * 2 > 9 THEN g * 2 - 9 ELSE g * 2 END ELSE g END) AS t FROM e GROUP BY 1)
       SELECT c_custkey, t % 10 = 0 AS valid FROM s""",
)
def npi_check_digit(t):
    npi = (F.lit(1_000_000_000) + F.col("c_custkey") * 7).cast("string")
    return t.customer.select("c_custkey", X.npi_valid(npi).alias("valid"))


@query("identifier_columns", """WITH s AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b FROM orders)
   SELECT 'o_orderkey' AS "column", a / n >= 0.9 AS near_unique FROM s UNION ALL SELECT 'o_custkey', b / n >= 0.9 FROM s""")
def identifier_columns(t):
    from plumbline.operators.joins import detect_key

    d = detect_key(t.orders.select("o_orderkey", "o_custkey"))
    return d.select("column", (F.col("distinct_values") / (F.col("rows") - F.col("nulls")) >= Z.NEAR_UNIQUE).alias("near_unique"))
