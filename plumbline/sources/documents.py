"""Page text and transcript segments as tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import col


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, spaces folded."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def page_rows(df: DataFrame, page: str, text: str) -> DataFrame:
    return df.select(col(page).alias("page_number"), F.coalesce(col(text), F.lit("")).alias("text"))


def page_coverage(pages: DataFrame) -> DataFrame:
    """Pages with and without text, and the status: none fails, some missing warns."""
    has = F.trim("text") != ""
    s = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(has).alias("with_text"), F.count_if(~has).alias("without_text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    st = F.when(F.col("with_text") == 0, "fail").when(F.col("without_text") > 0, "warn").otherwise("pass")
    return s.withColumn("status", st)


def transcript_rows(df: DataFrame, start: str, end: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Segments with duration, words and words per minute."""
    t = F.trim(col(text))
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")
    dur = col(end) - col(start)
    return df.select(
        *[col(k) for k in keep], col(start).alias("start_sec"), col(end).alias("end_sec"), dur.alias("duration_sec"), t.alias("text"), F.length(t).cast("long").alias("char_count"), words.alias("word_count"),
        F.round(F.try_divide(words.cast("double"), dur) * 60, 1).alias("words_per_minute"),
    )


def transcript_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("segments"), F.sum("duration_sec").alias("duration_sec"), F.sum("word_count").alias("words"), F.round(F.avg("words_per_minute"), 1).alias("mean_wpm"))
