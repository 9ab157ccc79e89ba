"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

A token's score is its log-odds between toxic and other labelled documents under a Dirichlet prior
taken from all documents, less twice its standard error, so that only sure tokens count. All other
tokens cost a little. A linear scan finds every maximal segment of a text. How often chance makes a
segment of a score in a text of its length follows from the extreme-value law of such scans; the
evidence of the passages that chance hardly makes is added up and calibrated to a likelihood.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import in_training, others, text_of, text_slices, written
from plumbline.llm.shingles import sketch
from plumbline.model import col

WORD = re.compile(r"[^\W\d_]+")
BITS = 18
PRIOR = 0.1  # weight of the prior against the tokens of the other documents
SURE = 2.0  # standard errors taken off a score
COST = 0.25  # of a token without score
RARE = 0.05  # expected number by chance up to which a passage counts
STEP, STEPS = 0.5, 200  # evidence is calibrated in bins of this width


class Bins(dict):
    """The bin of a word, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return b


def bins_of(text: str, known: Bins) -> np.ndarray:
    found = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label) of training rows; a document with several labels counts with the largest, nulls aside."""
    own = labels.where(in_training(col(key)) & col(label).isin(0, 1))
    # joined the same way at every size: labels grow with the documents
    return own.groupBy(col(key).alias("id")).agg(F.max(col(label)).cast("int").alias("label")).hint("merge")


def token_counts(docs: DataFrame, own: DataFrame) -> np.ndarray:
    """Documents that hold a token, by bin: three rows, for all documents, other and toxic training ones."""
    marked = docs.join(own, docs["doc"] == own["id"], "left").select("text", F.coalesce(F.col("label") + 1, F.lit(0)).alias("kind"))

    def slots_of():
        known = Bins()

        def find(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist()):
                b = np.unique(bins_of(text.as_py(), known))
                yield b if not kind else np.concatenate([b, b + (kind << BITS)])

        return find

    return sketch(marked, slots_of, BITS + 2).reshape(4, -1)[:3]


def token_scores(counts: np.ndarray) -> np.ndarray:
    """Scores by bin, the cost taken off; -COST everywhere without labelled documents of both kinds."""
    everything, other, toxic = counts.astype(float)
    if not toxic.sum() or not other.sum():
        return np.full(counts.shape[1], -COST)
    prior = PRIOR * other.sum() * (everything + 1e-3) / (everything + 1e-3).sum()
    y1, y0 = toxic + prior, other + prior
    odds = np.log(y1 / (y1.sum() - y1)) - np.log(y0 / (y0.sum() - y0))
    return np.maximum(0.0, odds - SURE * np.sqrt(1 / y1 + 1 / y0)) - COST


def decay(scores: np.ndarray, weight: np.ndarray) -> float:
    """The rate at which high scores get rare by chance: the positive root of E[exp(rate * score)] = 1."""
    p = weight / max(weight.sum(), 1)
    keep = p > 0
    s, p = scores[keep], p[keep]
    if not len(s) or s.max() <= 0 or (p * s).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * s)).sum() < 1 else (low, middle)
    return low


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, sum) with a positive sum, in linear time.

    A segment is maximal if no part of it and no longer segment has a larger sum. Candidates are
    kept with the sums before and after them; a new one joins those that it tops.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    starts: list[int] = []
    ends: list[int] = []
    below: list[int] = []  # the nearest earlier candidate that begins lower
    for i in np.flatnonzero(score > 0).tolist():
        start, end = i, i + 1
        while True:
            j = len(starts) - 1
            while j >= 0 and total[starts[j]] >= total[start]:
                j = below[j]
            if j < 0 or total[ends[j]] >= total[end]:
                starts.append(start)
                ends.append(end)
                below.append(j)
                break
            start = starts[j]
            del starts[j:], ends[j:], below[j:]
    return [(a, b, float(total[b] - total[a])) for a, b in zip(starts, ends)]


def passages(df: DataFrame, scores: np.ndarray, keep: tuple[str, ...], text: str) -> DataFrame:
    """``keep`` as ``k0``, ``k1`` and so on, ``n_words`` and ``passages``: every maximal segment as (start, end, score), in words from 0."""
    shared = df.sparkSession.sparkContext.broadcast(scores.astype(np.float32))  # 2 ** BITS numbers
    kept = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[col(k).alias(a) for k, a in zip(keep, kept)], text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Bins(), shared.value.astype(float)
        for batch in batches:
            for part in text_slices(batch, "text"):
                n, found = [], []
                for t in part.column("text"):
                    score = own[bins_of(t.as_py(), known)]
                    n.append(len(score))
                    found.append([{"start": a, "end": b, "score": s} for a, b, s in segments(score)])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*[part.column(a) for a in kept], pa.array(n, pa.int32()), pa.array(found, kind)], names=[*kept, "n_words", "passages"])

    types = "".join(f"{a} {source.schema[a].dataType.simpleString()}, " for a in kept)
    return source.mapInArrow(run, types + "n_words int, passages array<struct<start:int,end:int,score:double>>")


def by_chance(score: Column, n_words: Column, rate: float, density: float) -> Column:
    """How many segments of this score or more chance is expected to make in a text of this length."""
    return F.lit(density) * n_words * F.exp(-F.lit(rate) * score)


def logistic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likelihood of label 1 given evidence, slightly smoothed, by Newton's method."""
    slope, offset = 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ [slope, offset], -30, 30)))
        gradient = design.T @ (ones - n * p) - [1e-3 * slope, 1e-3 * offset]
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5 / np.abs(step).max(initial=1e-12))
        slope, offset = slope + step[0], offset + step[1]
    return slope, offset


def scored(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (likelihood of label 1, from 0 to 1) and ``passages``, the significant ones.

    Labels are learned from rows with ``in_training`` ids; counts cover all documents. Words are
    runs of letters in lower case; null and empty texts have none and no evidence. Repeated rows
    score alike. Without labels of both kinds nothing is toxic and every score is 0. Texts of any
    length are scanned whole; an empty table gives no rows. A column of ``keep`` named ``score`` or
    ``passages`` is left out for the result; other columns, whatever their names, play no part.
    """
    docs = df.select(col(key).alias("doc"), text_of(text).alias("text"))
    own = labelled(labels, key, label)
    counts = token_counts(docs, own)
    scores = token_scores(counts)
    rate = decay(scores, counts[0].astype(float))
    keep = others(keep, ("score", "passages"))
    names = tuple(dict.fromkeys((*keep, key)))
    found = written(passages(df, scores, names, text), "passages")
    doc = F.col(f"k{names.index(key)}")
    known = found.join(own, doc == own["id"])
    total = known.where("label = 0").agg(
        F.coalesce(F.sum(F.col("n_words").cast("long")), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.aggregate("passages", F.lit(0.0), lambda a, p: a + F.when(p["score"] >= 1.0, 1.0).otherwise(0.0))), F.lit(0.0)).alias("high"),
    ).first()
    # as many segments of score 1 and more as the other documents have by chance, and one
    density = (total["high"] + 1.0) * float(np.exp(rate)) / max(total["words"], 1)
    sure = lambda p: by_chance(p["score"], F.col("n_words"), rate, density) < RARE
    kept = F.filter("passages", sure)
    weigh = lambda a, p: a - F.log(by_chance(p["score"], F.col("n_words"), rate, density))
    found = found.withColumn("passages", kept)
    evidence = F.least(F.aggregate("passages", F.lit(0.0), weigh), F.lit(STEP * STEPS))
    found = found.withColumn("_evidence", evidence)
    bins = found.join(own, doc == own["id"]).groupBy(F.round(F.col("_evidence") / STEP).cast("int").alias("bin"))
    rows = bins.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()  # STEPS + 1 rows at most
    if not counts[2].sum() or not counts[1].sum():
        score = F.lit(0.0)
    else:
        slope, offset = logistic(np.array([r["bin"] * STEP for r in rows]), np.array([r["ones"] for r in rows], float), np.array([r["n"] for r in rows], float))
        score = 1 / (1 + F.exp(-(F.col("_evidence") * F.lit(float(max(slope, 0.0))) + F.lit(float(offset)))))
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], score.alias("score"), "passages")
