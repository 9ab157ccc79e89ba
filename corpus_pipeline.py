"""The corpus pipeline: from raw documents to token ids in training order.

Quality filter, line dedup, one document of each near-duplicate group, mixing by source with copies
in curriculum order, then BPE. Each stage works on what the one before kept; all but the last
return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard_join, line_dedup, mixing, quality
from plumbline.llm.common import unused, written
from plumbline.llm.queries import tokenizer_spec
from plumbline.model import col

LEAST_QUALITY = 0.3


def same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; labels are those of the data folder.

    Null and empty texts get the share of good labels as their score. Repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (score,) = unused(docs, "_score")
    scored = quality.scored(docs, labels, keep=tuple(docs.columns), score=score)
    return same_columns(scored.where(F.col(score) >= LEAST_QUALITY), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document repeats; a document without lines left stays, empty.

    ``n_chars``, if it is there, is counted again where lines went. Null texts stay null.
    """
    counts = tuple(unused(docs, "_n_lines", "_n_dropped"))
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), counts=counts)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return same_columns(cut, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by shingle likeness of 0.8.

    Documents without words link with nothing; of rows with the same id and text one stays.
    """
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, as rows in order of time due.

    Whole documents only: a copy that the mix cuts off is taken if half of its words or more are.
    Documents without words are in no mix. Rows with the same id and text are documents of their
    own, each with its copies.
    """
    row, due = unused(docs, "_row", "_due")
    keyed = docs.withColumn(row, line_dedup.row_key("doc_id", "text"))
    mixed = mixing.mix(keyed, keep=(row,)).select(F.col(row), "size", F.explode("copies").alias("copy")).where("copy.words * 2 >= size")
    copies = mixed.select(row, F.col("copy.due").alias(due))
    rows = keyed.dropDuplicates([row]).join(copies, row).repartitionByRange(due, row).sortWithinPartitions(due, row)
    return same_columns(rows, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the text decoded from them; null and empty texts have none."""
    encoded = bpe.encode(docs, tokenizer_spec())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

#: The classifier is not to be expressed in SQL; tests/llm hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
