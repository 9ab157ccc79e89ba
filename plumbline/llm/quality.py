"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words, the shapes of its words (case, digits, punctuation), pairs of
neighbouring shapes, and repetition. Document frequencies are counted over all documents. A
bounded sample of labelled documents gives the latent space (singular vectors of their term
matrix) and the labelled vectors, which are broadcast. Every document is projected, compared with
every labelled vector by exact cosine in blocks, and takes the votes of its nearest, weighted by
similarity.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import array_slices, in_training, others, returned, text_of, text_slices
from plumbline.llm.shingles import sketch
from plumbline.model import col

BITS = 16
SHAPES, PAIRS = 1 << 12, 1 << 14  # bins up to SHAPES are shapes, up to PAIRS pairs of shapes, the rest words
REPEATED, RUNS, PHRASES, LENGTH = 0, 1, 2, 3  # the first bins are kept for repetition
TERMS, LATENT, SAMPLE, NEIGHBOURS = 2048, 64, 6000, 32


DIGIT, LETTER, RUN = re.compile(r"\d"), re.compile(r"[^\W\d_]"), re.compile(r"(.)\1+")
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def shape(word: str) -> str:
    """Letters, digits and other characters by kind, runs shortened: ``Word,`` is ``Aa,``, ``12%%%`` is ``9%%``."""
    core = word.rstrip(PUNCTUATION)
    tail = word[len(core) :]
    if len(tail) > 1:
        tail = RUN.sub(lambda m: m[1] * 2, tail)
    if core.isascii() and core.isalpha():  # the same as below, for plain words
        if core.islower():
            return "a" + tail[:11]
        if core[1:].islower():
            return "Aa" + tail[:10]
    kinds = LETTER.sub(lambda m: "A" if m[0].isupper() else "a", DIGIT.sub("9", core))
    return (RUN.sub(lambda m: m[1] if m[1] in "a9" else m[1] * 2, kinds) + tail)[:12]


class Words(dict):
    """A 64-bit number per word, its shape's bin in the low 12 bits; kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        kind = 8 + xxhash.xxh3_64_intdigest(shape(word)) % (SHAPES - 8)
        own = xxhash.xxh3_64_intdigest(word.lower())
        self[word] = out = own & ~0xFFF & (2**64 - 1) | kind
        return out


def terms(text: str, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a text and their weights: root of the share of words, repetition as shares."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    v = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    kinds = (v & np.uint64(0xFFF)).astype(np.int64)
    own = v >> np.uint64(12)
    pairs = SHAPES + (kinds[:-1] * 4093 + kinds[1:]) % (PAIRS - SHAPES)
    items = PAIRS + (own % np.uint64((1 << BITS) - PAIRS)).astype(np.int64)
    bins, counts = np.unique(np.concatenate([kinds, pairs, items]), return_counts=True)
    phrases = own[: max(1, n - 4)].copy()
    for i in range(1, min(5, n)):
        phrases = phrases * np.uint64(1_000_003) + own[i : i + len(phrases)]
    shares = {
        REPEATED: 1 - len(np.unique(own)) / n,
        RUNS: float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0,
        PHRASES: 1 - len(np.unique(phrases)) / len(phrases),
        LENGTH: 1 / np.sqrt(n),
    }
    extra = np.fromiter(shares, np.int64), np.fromiter(shares.values(), float)
    return np.concatenate([extra[0], bins]), np.concatenate([extra[1] * 2, np.sqrt(counts / n)])


@dataclass
class Model:
    """The latent space and the labelled vectors: sizes are bounded by TERMS, LATENT and SAMPLE."""

    column: np.ndarray  # of every bin, -1 without
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # of each labelled row, to undo uneven sampling
    neighbours: int
    prior: float

    def matrix(self, texts: list[str], known: Words) -> np.ndarray:
        out = np.zeros((len(texts), len(self.weight)), np.float32)
        for i, text in enumerate(texts):
            bins, values = terms(text, known)
            at = self.column[bins]
            out[i, at[at >= 0]] = values[at >= 0]
        out *= self.weight
        return out

    def project(self, texts: list[str], known: Words) -> np.ndarray:
        x = self.matrix(texts, known)
        return unit_rows(unit_rows(x) @ self.basis)

    def score(self, texts: list[str], known: Words) -> np.ndarray:
        """The share of the votes of the nearest labelled vectors for label 1; the prior without any."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(self.neighbours, len(self.labels))
        for start in range(0, len(texts), 256):
            cosine = self.project(texts[start : start + 256], known) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            c = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(float)
            vote = np.exp(20 * (c - 1)) * self.votes[near] * (c > 0)
            total = vote.sum(axis=1)
            good = (vote * self.labels[near]).sum(axis=1)
            # one vote of the prior keeps texts unlike all others near it
            out[start : start + 256] = (good + 1e-6 * self.prior) / (total + 1e-6)
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def space(frequency: np.ndarray, n_docs: int, n_terms: int) -> Model:
    """The most frequent terms and their weights; ``frequency`` counts the documents of each bin over the whole corpus."""
    frequency = frequency.copy()
    frequency[:4] = n_docs + 1
    chosen = np.lexsort((np.arange(len(frequency)), -frequency))[:n_terms]
    chosen = chosen[frequency[chosen] > 0]
    column = np.full(len(frequency), -1)
    column[chosen] = np.arange(len(chosen))
    weight = np.log((n_docs + 2) / (np.minimum(frequency[chosen], n_docs) + 1)).astype(np.float32) + np.float32(0.5)
    none = np.zeros((0, 1), np.float32)
    return Model(column, weight, none, none, np.zeros(0), np.zeros(0), 0, 0.5)


def fit(model: Model, rows: list[np.ndarray], labels: np.ndarray, votes: np.ndarray, n_latent: int, neighbours: int) -> Model:
    """The model with the latent space of the labelled rows, given in parts of unit length, and their vectors."""
    if len(labels):
        products = sum(x.T @ x for x in rows)
        basis = np.ascontiguousarray(np.linalg.eigh(products)[1][:, ::-1][:, :n_latent])
        prior = float((labels * votes).sum() / votes.sum())
        own = np.concatenate([unit_rows(x @ basis) for x in rows])
        model = replace(model, basis=basis, vectors=own, labels=labels, votes=votes, neighbours=neighbours, prior=prior)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """(text, label, share): training rows, at most ``most`` of each label, least by a digest of the id.

    A document with several labels counts with the least, nulls aside. ``share`` says which part of
    the label's rows was taken.
    """
    own = labels.where(in_training(col(key)) & col(label).isin(0, 1)).groupBy(col(key).alias("id")).agg(F.min(col(label)).cast("int").alias("label"))
    parts = []
    for value in (0, 1):
        rows = own.where(F.col("label") == value)
        parts.append(rows.orderBy(F.xxhash64("id"), "id").limit(most))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * most ids
    return docs.select(F.col("doc").alias("id"), "text").join(chosen, "id").select("id", "text", "label")


def label_counts(labels: DataFrame, key: str, label: str) -> DataFrame:
    return labels.where(in_training(col(key)) & col(label).isin(0, 1)).groupBy(col(label).cast("int").alias("label")).count()


def sample_rows(chosen: DataFrame, model: Model) -> DataFrame:
    """(id, label, terms, order): the sample's weighted terms, of fixed length whatever the texts are."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Words(), shared.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                x = own.matrix(part.column("text").to_pylist(), known)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                order = [xxhash.xxh3_64_intdigest(t.as_py()) >> 1 for t in part.column("text")]
                columns = [part.column("id"), part.column("label"), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))), pa.array(order, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "terms", "order"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, label int, terms array<float>, order long")


def fitted(rows: DataFrame, empty: Model, there: dict[int, int], n_latent: int, neighbours: int) -> Model:
    """The model of the sample's rows, fitted in a task: the driver gets the latent space and the vectors alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, parts = [], []
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                labels.append(part.column("label").to_numpy().astype(float))
                parts.append(unit_rows(part.column("terms").flatten().to_numpy().reshape(part.num_rows, -1)))
        if parts:
            y = np.concatenate(labels)
            votes = np.array([there[v] / (y == v).sum() for v in y])
            model = fit(empty, parts, y, votes / votes.max(), n_latent, neighbours)
            arrays = [model.basis.tobytes(), model.vectors.tobytes(), y.tobytes(), model.votes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()) for a in arrays] + [pa.array([model.prior])], names=["basis", "vectors", "labels", "votes", "prior"])

    found = rows.mapInArrow(lambda batches: returned(run(batches)), "basis binary, vectors binary, labels binary, votes binary, prior double").collect()  # a row: the sample is sorted into one task
    if not found:
        return empty
    r = found[0]
    labels, votes = np.frombuffer(r.labels), np.frombuffer(r.votes)
    basis = np.frombuffer(r.basis, np.float32).reshape(len(empty.weight), -1)
    return replace(empty, basis=basis, vectors=np.frombuffer(r.vectors, np.float32).reshape(len(labels), -1), labels=labels, votes=votes, neighbours=neighbours, prior=r.prior)


def scored(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep: tuple[str, ...] = ("doc_id",),
    n_terms: int = TERMS,
    n_latent: int = LATENT,
    sample: int = SAMPLE,
    neighbours: int = NEIGHBOURS,
    score: str = "score",
) -> DataFrame:
    """``keep`` and a column ``score``: how likely the label is 1, from 0 to 1.

    Labels are learned from rows with ``in_training`` ids only, at most ``sample`` rows (half of
    each label at most); the score is made from the text alone. Null and empty texts are texts
    without terms: they and texts without any neighbour get the share of label 1. Very long texts
    are scored whole. Repeated rows get the same score; without labels every score is 0.5; an empty
    table gives no rows. A column of ``keep`` with the name of ``score`` is left out for it; other
    columns, whatever their names, play no part.

    Terms are the ``n_terms`` commonest of all documents, after those that tell of repetition; rarer
    ones tell nothing. Terms share ``2 ** BITS`` bins by their hash. Both bound the model, not the rows.
    """
    spark = df.sparkSession
    docs = df.select(col(key).alias("doc"), text_of(text).alias("text"))
    def slots_of():
        known = Words()

        def find(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for t in batch.column(0):
                yield np.append(terms(t.as_py(), known)[0][4:], REPEATED)

        return find

    frequency = sketch(docs.select("text"), slots_of, BITS)
    empty = space(frequency, int(frequency[REPEATED]), n_terms)
    chosen = labelled_sample(docs, labels, key, label, sample // 2)
    there = {r["label"]: r["count"] for r in label_counts(labels, key, label).collect()}  # two rows
    rows = sample_rows(chosen, empty).orderBy("order", "id").limit(sample)
    model = spark.sparkContext.broadcast(fitted(rows, empty, there, n_latent, neighbours))

    def likely(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, own = Words(), model.value
        for batch in texts:
            scores = [own.score(part.to_pylist(), known) for part in array_slices(batch)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    def scores_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return returned(likely(texts))

    # a score comes back from Python, no text: Spark keeps the other columns with itself
    found = F.arrow_udf(scores_of, "double")(text_of(text)).alias(score)
    return df.select(*[col(k) for k in others(keep, [score])], found)
