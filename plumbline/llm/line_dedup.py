"""Line dedup: lines that stand in several documents stay in one of them.

Hashes of lines are range-partitioned with document and position as secondary sort keys and read
in that order: the first document of a hash keeps the line. A hash with very many lines fills
several ranges; only the first and the last hash of a range can go on in another, and those few
are summed up apart. The result is a run-length bitmap of kept lines per document, no text.
Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import others, text_of, unused, written
from plumbline.model import col

SPACE = "\t\n\x0b\x0c\r\x20"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 20, 3
SECOND_SEED = 0x5DEECE66D


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_key(key: str, text: str) -> Column:
    """Tells rows of one document id with different texts apart."""
    return F.xxhash64(col(key), text_of(text))


def line_rows(df: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """One row per line long enough: 128-bit hash of its key, document, row, position, lines of the text."""
    lines = F.split(text_of(text), "\n", -1)
    rows = df.select(col(key).alias("_doc"), row_key(key, text).alias("_row"), F.posexplode(lines).alias("_pos", "_line"), F.size(lines).alias("_n"))
    keyed = rows.withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= least_chars)
    return keyed.select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(SECOND_SEED), F.col("_key")).alias("_h2"), "_doc", "_row", "_pos", "_n"
    )


def repeated_lines(df: DataFrame, key: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """The lines to drop: their key is found in ``least_docs`` documents and another, larger, one keeps it."""
    order = [F.col("_h1"), F.col("_h2"), F.col("_doc").desc_nulls_last(), F.col("_pos")]
    lines = written(line_rows(df, key, text, least_chars), "lines")
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "lines-by-hash")
    # The first and last hash of every range: two rows for each at most, which bounds the broadcasts.
    ends = ranged.groupBy("_range").agg(F.min(F.struct("_h1", "_h2")).alias("a"), F.max(F.struct("_h1", "_h2")).alias("b"))
    ends = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).groupBy("e._h1", "e._h2").count()
    over = ends.where("count > 1").select("_h1", "_h2")
    border = (
        ranged.join(F.broadcast(over), ["_h1", "_h2"])
        .groupBy("_h1", "_h2", "_doc")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2")
        .agg(F.count("_one").alias("_all_docs"), F.max("_doc").alias("_all_last"))
    )
    hashes = Window.partitionBy("_range", "_h1", "_h2")
    here = ranged.withColumn("_nth", F.dense_rank().over(hashes.orderBy(F.col("_doc").desc_nulls_last())))
    here = here.withColumn("_docs", F.max("_nth").over(hashes)).join(F.broadcast(border), ["_h1", "_h2"], "left")
    docs = F.coalesce("_all_docs", "_docs")
    first = F.when(F.col("_all_docs").isNull(), F.col("_nth") == 1).otherwise(F.col("_doc").eqNullSafe(F.col("_all_last")))
    return here.where((docs >= least_docs) & ~first)


def keep_bitmaps(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """One row for each document that loses lines: ``doc``, ``row`` (see ``row_key``), ``n_dropped``, ``keep``.

    ``keep`` is the compressed bitmap of kept lines: its runs of ones as (start, length), from 0.
    Lines end at ``\\n``; a null or empty text is one empty line. A line counts by its key (see
    ``line_key``) if that has ``least_chars`` code points; found in ``least_docs`` documents it
    stays only in the largest document id that holds it, however often it stands there. Rows with
    the same id are one document, rows without id together another, smaller than all.
    """
    drop = repeated_lines(df, key, text, least_chars, least_docs)
    per = drop.groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_set"), F.max("_n").alias("_n"))
    edges = F.concat(F.array(F.lit(-1)), F.array_sort("_set"), F.array(F.col("_n")))

    def runs(e: Column) -> Column:
        gap = lambda at, i: F.struct((at + 1).alias("start"), (F.element_at(e, i + 2) - at - 1).alias("length"))
        return F.filter(F.transform(F.slice(e, 1, F.size(e) - 1), gap), lambda r: r["length"] > 0)

    keep = F.transform(F.array(edges), runs)[0]  # binds the edges once
    return per.select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), F.size("_set").cast("long").alias("n_dropped"), keep.alias("keep"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """``df`` with ``text`` cut to its kept lines, and ``counts``: lines before, lines dropped.

    Columns of ``df`` with the names of ``counts`` are replaced; all others stay, whatever their names.
    """
    doc, row, dropped, keep, own = unused(df, "_doc", "_row", "_dropped", "_keep", "_own")
    b = bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))
    rows = df.withColumn(own, row_key(key, text))
    joined = rows.join(b, col(key).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(row)), "left")
    lines = F.split(text_of(text), "\n", -1)
    cut = lambda all_lines: F.flatten(F.transform(keep, lambda r: F.slice(all_lines, r["start"] + 1, r["length"])))
    kept = F.when(F.col(keep).isNull(), col(text)).otherwise(F.array_join(F.transform(F.array(lines), cut)[0], "\n"))
    n_lines = F.length(text_of(text)) - F.length(F.replace(text_of(text), F.lit("\n"))) + 1
    stay = [kept.alias(c) if c == text else col(c) for c in others(df.columns, counts)]
    return joined.select(*stay, n_lines.cast("long").alias(counts[0]), F.coalesce(dropped, F.lit(0)).cast("long").alias(counts[1]))
