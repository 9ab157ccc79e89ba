"""Queries of this subpackage, each over its whole table, and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_spec(path: str | None = None) -> str:
    """The content of the tokenizer file; by default the 49,000-token word-end vocabulary of ``public_tokenizers``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@query
def op3_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Every text as token ids and back, as digests."""
    from plumbline.llm import bpe

    return bpe.digests(bpe.encode(table(spark, root, "documents"), tokenizer_spec()))


@query
def op9_mixing(spark: SparkSession, root: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1 to 150 % of their words."""
    from plumbline.llm import mixing

    mixed = mixing.mix(table(spark, root, "documents"))
    # training positions: the times from 0 to 1 at which the first and the last copy are due
    last = F.try_element_at("copies", F.lit(-1))["due"]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("due", 9).alias("due"), F.round(last, 9).alias("last_due"))


SQL["op9_mixing"] = r"""
with docs as (
  select doc_id, case when source is null then '1' else '0' || source end as s,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix' || doc_id) as o
  from documents
), sources as (
  select *, list_value(5, 2, 1)[(row_number() over (order by s) - 1) % 3 + 1] as weight
  from (select s, sum(size)::bigint as source_size from docs group by s)
), capped as (
  select 2.0 * source_size / weight as ratio, sum(source_size) over w as sizes, sum(weight) over w as weights,
    (select sum(source_size) from sources) as total, (select sum(weight) from sources) as all_weights
  from sources window w as (order by 2.0 * source_size / weight, s rows unbounded preceding)
), levels as (
  select (1.5 * total - 2.0 * sizes) / (all_weights - weights) as level, weights, lead(ratio) over (order by weights) as next_ratio
  from capped where all_weights > weights
  union all select 1.5 * total / all_weights, 0, min(ratio) from capped group by total, all_weights
), level as (
  select arg_min(level, weights) as level from levels where next_ratio is null or next_ratio >= level
), shares as (
  select s, weight, source_size, case when 2.0 * source_size < weight * level then 2.0 * source_size else weight * level end as target
  from sources, level
), placed as (
  select doc_id, size, weight, source_size, target, floor(target)::bigint as asked,
    coalesce(sum(size) over (partition by s order by o, size rows between unbounded preceding and 1 preceding), 0) as start
  from docs join shares using (s)
), walked as (
  select *, asked // greatest(source_size, 1) as laps, greatest(0, least(size, asked % greatest(source_size, 1) - start)) as rest,
    -- weights at times 0, 1/2 and 1
    case weight when 5 then [1.5, 1, 0.5] when 2 then [1, 1, 1] else [0.5, 1, 1.5] end::double[] as w
  from placed
), parts as (
  -- shares of the demand at the middle of the first and of the last copy
  select *, case when laps > 0 and size > 0 then (start + size / 2) / asked when rest > 0 then (start + rest / 2) / asked end as p1,
    case when rest > 0 then (laps * source_size + start + rest / 2) / asked when laps > 0 and size > 0 then ((laps - 1) * source_size + start + size / 2) / asked end as p2
  from walked
), due as (
  select *, list_transform([p1, p2], lambda p: case
    when p <= (w[1] + w[2]) / 4 then (p * 4 / (w[1] + w[2])) * (w[1] + w[2]) / (w[1] + sqrt(w[1] * w[1] + (p * 4 / (w[1] + w[2])) * (w[2] * w[2] - w[1] * w[1]))) / 2
    else (1 + ((p - (w[1] + w[2]) / 4) * 4 / (w[2] + w[3])) * (w[2] + w[3]) / (w[2] + sqrt(w[2] * w[2] + ((p - (w[1] + w[2]) / 4) * 4 / (w[2] + w[3])) * (w[3] * w[3] - w[2] * w[2])))) / 2 end) as t
  from parts
)
select doc_id, size::bigint as size, source_size, target::double as target, (laps * size + rest)::bigint as taken, round(t[1], 9) as due, round(t[2], 9) as last_due
from due
"""


@query
def op5_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the lines that a later document repeats."""
    from plumbline.llm import line_dedup

    docs = table(spark, root, "documents").select("doc_id", "text")
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


SQL["op5_line_dedup"] = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from split
), repeated as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.line, k.pos, r.key is not null and k.doc_id <> r.last as dropped from keyed k left join repeated r using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op10_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    """Documents linked by a Jaccard likeness of 0.8 of their five-word shingles."""
    from plumbline.llm import jaccard_join

    found = jaccard_join.similar_sets(table(spark, root, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


SQL["op10_jaccard_join"] = r"""
with recursive texts as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from texts
), items as (
  select doc_id, len(s) as n, unnest(s) as item from sets
), common as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as shared
  from items a join items b on a.item = b.item and a.doc_id < b.doc_id
    and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  group by all
), links as (
  select a, b from common where 100 * shared >= 80 * (n_a + n_b - shared)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from sets
  union
  select r.a, l.b from reach r join both_ways l on r.b = l.a
)
select doc_id, len(s)::bigint as n_shingles, (select min(b) from reach where a = doc_id) as component_id from sets
"""


@query
def op1_embedding_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of one label within cosine 0.93, and their components."""
    from plumbline.llm import embedding_dedup

    return embedding_dedup.near_vectors(table(spark, root, "embeddings")).withColumnRenamed("id", "vec_id")


SQL["op1_embedding_dedup"] = r"""
with recursive vectors as (
  select vec_id, label, embedding::double[] as v from embeddings
), links as (
  select a.vec_id as a, b.vec_id as b
  from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from vectors
  union
  select r.a, l.b from reach r join links l on r.b = l.a
)
select vec_id, (select count(*) from links where a = vec_id) as n_links, min(b) as component_id, min(b) = vec_id as kept
from reach join vectors on a = vec_id group by vec_id
"""


def judged(scored: DataFrame, least: float) -> DataFrame:
    """The columns of a judged document: whether its label was held out, score and prediction."""
    from plumbline.llm.common import in_training

    held_out = ~in_training(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query
def op4_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of every document, by votes of the nearest labelled ones."""
    from plumbline.llm import quality

    return judged(quality.scored(table(spark, root, "documents"), table(spark, root, "labels")), 0.3)


@query
def op7_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity of every document, by its maximum-scoring passages."""
    from plumbline.llm import toxicity

    return judged(toxicity.scored(table(spark, root, "documents"), table(spark, root, "labels")), 0.5)


@query
def op6_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of every document and of its text edited with that of the next."""
    from plumbline.llm import fingerprints

    return fingerprints.edited_neighbours(table(spark, root, "documents")).withColumnRenamed("doc", "doc_id")


@query
def op2_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """Secrets in every document; a source is an owner, a document a repository."""
    from plumbline.llm import secret_scan

    found = secret_scan.scan(table(spark, root, "documents"))
    verdicts = ["n_owned", "n_shared", "n_copied", "most_owners", "most_repositories"]
    return found.select(F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", *verdicts)


def _secret_sql() -> str:
    from plumbline.llm.secret_scan import ACCESS, ASSIGN, HEX, TOKEN

    def kind(name: str, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return f"""
  select doc_id, source, '{name}' as kind, unnest(regexp_extract_all(text, '{p}')) as m,
    unnest(string_split_regex(text, '{p}')[:-2]) as gap, unnest(range(len(regexp_extract_all(text, '{p}')))) as idx
  from texts where regexp_matches(text, '{p}')"""

    union = " union all ".join(kind(n, p) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)))
    assign = ASSIGN.replace("'", "''")
    return f"""
with texts as (
  select doc_id, source, coalesce(text, '') as text from documents
), found as ({union}
), valued as (
  select *, case when kind = 'assign' then regexp_extract(m, '{assign}', 2) else m end as value,
    sum(len(gap) + len(m)) over (partition by doc_id, kind order by idx) as "end"
  from found
), spans as (
  select *, len(value) >= 16 and regexp_matches(value, '[A-Za-z]') and regexp_matches(value, '[0-9].*[0-9]') as candidate,
    kind <> 'token' and (kind <> 'assign' or len(value) >= 6) as base
  from valued
), held as (
  select distinct value, coalesce(source, chr(0)) as owner, doc_id from spans where candidate
), owners as (
  select value, count(distinct owner) as n, count(*) as repositories, case when count(distinct owner) >= 3 or count(*) >= 10 then 'copied' when count(distinct owner) = 1 then 'owned' else 'shared' end as verdict
  from held group by value
), listed as (
  select doc_id, "end" - len(m) as start, "end", kind, case kind when 'assign' then 0 when 'access' then 1 else 2 end as o from spans where base
  union
  select doc_id, "end" - len(value), "end", 'owned', 3 from spans join owners using (value) where candidate and verdict = 'owned'
), joined as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, o, "end") filter (o < 3) as base,
    string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, o, "end") as spans
  from listed group by doc_id
), counted as (
  select doc_id, count(distinct value) filter (verdict = 'owned') as n_owned, count(distinct value) filter (verdict = 'shared') as n_shared,
    count(distinct value) filter (verdict = 'copied') as n_copied, max(n) as most_owners, max(repositories)::bigint as most_repositories
  from spans join owners using (value) where candidate group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_owned, 0) as n_owned, coalesce(n_shared, 0) as n_shared, coalesce(n_copied, 0) as n_copied,
  coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories
from documents left join joined using (doc_id) left join counted using (doc_id)
"""


SQL["op2_secret_scan"] = _secret_sql()


@query
def op8_language_id(spark: SparkSession, root: str) -> DataFrame:
    """The language of every page, from its text, markup, address suffix and host."""
    from plumbline.llm import language_id

    found = language_id.identify(table(spark, root, "pages"), table(spark, root, "documents"))
    return found.withColumnRenamed("id", "page_id")


def tokenizer_file(name: str) -> bytes:
    """The content of a file of ``public_tokenizers``."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query
def op11_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Every text's tokens of two vocabularies, aligned at shared ends."""
    from plumbline.llm import token_alignment

    byte_spec = tokenizer_file("byte_bpe_50k.json").decode()
    found = token_alignment.aligned_documents(table(spark, root, "documents"), byte_spec, tokenizer_file("piece_bpe_32k.model"), whole=False)
    return found.withColumnsRenamed({"doc": "doc_id", "groups": "groups_sha256"})


@query
def op12_whitening(spark: SparkSession, root: str) -> DataFrame:
    """All embeddings on their 8 leading principal components, at unit variance."""
    from plumbline.llm import whitening

    found = whitening.whiten(table(spark, root, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_warc(spark: SparkSession, root: str) -> DataFrame:
    """All pages written as WARC records, copies as revisits, and read back."""
    from plumbline.llm import warc

    return warc.archived_pages(table(spark, root, "pages")).withColumnRenamed("key", "page_id")


SQL["op13_warc"] = r"""
with payloads as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), digests as (
  select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from payloads
), stored as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as last from digests
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last then last end as refers_to, true as intact
from stored
"""
