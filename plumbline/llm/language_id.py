"""Language ID by Bayesian evidence fusion.

The likelihood of a page's text under each language comes from character trigrams counted over all
documents with a known language. What pages declare in their markup, and what their hosts and
address suffixes hold, is learned from the pages themselves by grouped sums of text posteriors: a
host's prior leans on its suffix's, and that on all pages'. A page's own share is taken out of its
host's counts, so no page votes for itself.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, text_slices, written
from plumbline.llm.shingles import sketch
from plumbline.model import col

BITS = 15
MOST_LANGUAGES = 256
TEMPER = 0.25  # neighbouring trigrams share letters, so each counts for a part
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 4.0, 20.0, 20.0  # pages that a parent's shares stand for
TRUSTED = 0.9  # share of pages that declare a language and are written in it, before any is seen
HIDDEN = re.compile(r"(?is)<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->")
TAG = re.compile(r"(?s)<[^>]*>")


def visible(page: str) -> str:
    """The text of a page without scripts, styles, navigation, comments and tags."""
    return entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", page)))


def trigrams(text: str) -> np.ndarray:
    """Bins of the letter trigrams, words apart by one space."""
    flat = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    if len(flat) < 3:
        return np.zeros(0, np.int64)
    c = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = ((c[:-2] * np.uint64(0x1F35) + c[1:-1]) * np.uint64(0x1F35) + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def text_model(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-likelihoods (language, bin) with one count of every bin added."""
    known = F.array(*map(F.lit, languages))
    at = F.array_position(known, F.col("lang")) - 1
    rows = docs.where(F.col("lang").isin(languages)).select("text", at.cast("int").alias("at"))
    bits = BITS + max(1, (len(languages) - 1).bit_length())

    def slots_of():
        def find(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for text, at in zip(batch.column(0), batch.column(1).to_pylist()):
                yield trigrams(text.as_py()) + (at << BITS)

        return find

    counts = sketch(rows, slots_of, bits).reshape(-1, 1 << BITS)[: len(languages)] + 1.0
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def text_posteriors(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """``loglik``: per language, the tempered log-likelihood of the visible text against the best one's."""
    shared = pages.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # languages times 2 ** BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, "html"):
                rows = []
                for page in part.column("html"):
                    t = trigrams(visible(page.as_py()))
                    ll = TEMPER * own[:, t].sum(axis=1, dtype=float)
                    rows.append(ll - ll.max())
                names = [n for n in part.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(rows, pa.list_(pa.float64()))], names=[*names, "loglik"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.mapInArrow(run, types + ", loglik array<double>")


def shares(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.array(total), lambda t: F.transform(weights, lambda x: x / t))[0]


def sums(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The posteriors added up by group, as one array."""
    added = df.groupBy(*by).agg(*[F.sum(F.col("text")[i]).alias(f"s{i}") for i in range(n)])
    return added.select(*by, F.array(*[F.col(f"s{i}") for i in range(n)]).alias("sums"))


def blend(own: Column, parent: Column, weight: float, less: Column | None = None) -> Column:
    """Shares of ``own`` counts (without ``less``) with ``weight`` more spread as the parent's shares."""
    if less is None:
        return shares(F.zip_with(own, parent, lambda x, p: x + weight * p))
    rest = F.zip_with(own, less, lambda x, y: F.greatest(F.lit(0.0), x - y))
    return shares(F.zip_with(rest, parent, lambda x, p: x + weight * p))


def identify(
    pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Per page ``id``, ``lang``, ``probability``, ``text_lang``, ``declared``, ``host``, ``suffix``.

    Languages are those of ``docs`` (``MOST_LANGUAGES`` at most, more are an error). A page
    without text, host or declaration goes by what it has, without anything by the shares of all
    pages; ties go to the first language by name. Without any document of known language ``lang``
    is null. Repeated rows count each. A host of any size is added up before it is shuffled.
    """
    known = docs.select(text_of(text).alias("text"), col(lang).alias("lang"))
    languages = sorted(r[0] for r in known.select("lang").where("lang is not null").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(text_of(html), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit(""))
    rows = pages.select(col(key).alias("id"), host.alias("host"), F.element_at(F.split(host, "[.]"), -1).alias("suffix"), declared.alias("declared"), text_of(html).alias("html"))
    if not languages:
        none = F.lit(None).cast("string")
        return rows.select("id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "host", "suffix")
    n = len(languages)
    scored = written(text_posteriors(rows, text_model(known, languages)), "page-languages")
    scored = scored.withColumn("text", shares(F.transform("loglik", F.exp)))
    whole = scored.agg(*[F.coalesce(F.sum(F.col("text")[i]), F.lit(0.0)) for i in range(n)]).first()
    all_pages = F.array(*[F.lit((x + 1.0) / (sum(whole) + n)) for x in whole])
    suffixes = sums(scored, n, "suffix").select("suffix", blend(F.col("sums"), all_pages, SUFFIX_WEIGHT).alias("suffix_shares"))
    hosts = sums(scored.where("host is not null"), n, "host", "suffix").join(suffixes, "suffix").select("host", "suffix_shares", F.col("sums").alias("host_sums"))
    # a declaration says as much as its pages' texts differ from all pages; few of them, that it mostly holds
    said = sums(scored.where("declared is not null"), n, "declared")
    meant = F.zip_with(F.array(*map(F.lit, languages)), all_pages, lambda name, p: F.when(F.col("declared") == name, TRUSTED).otherwise(0.0) + (1 - TRUSTED) * p)
    says = said.select("declared", F.zip_with(blend(F.col("sums"), meant, DECLARED_WEIGHT), all_pages, lambda a, b: F.log(a / b)).alias("says"))
    joined = scored.join(hosts, "host", "left").join(says, "declared", "left")
    prior = F.when(F.col("host_sums").isNotNull(), blend(F.col("host_sums"), F.col("suffix_shares"), HOST_WEIGHT, F.col("text"))).otherwise(all_pages)
    joined = joined.withColumn("prior", prior)
    evidence = F.zip_with("loglik", "prior", lambda a, p: a + F.log(p))
    evidence = F.zip_with(evidence, F.coalesce("says", F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    joined = joined.withColumn("evidence", evidence)
    posterior = F.transform(F.array(F.array_max("evidence")), lambda m: shares(F.transform("evidence", lambda x: F.exp(x - m))))[0]
    joined = joined.withColumn("posterior", posterior)
    name = lambda c: F.element_at(F.array(*map(F.lit, languages)), F.array_position(c, F.array_max(c)).cast("int"))
    return joined.select(
        "id",
        name(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("probability"),
        name(F.col("text")).alias("text_lang"),
        "declared",
        "host",
        "suffix",
    )
