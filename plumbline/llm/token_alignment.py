"""Alignment of two tokenizers' tokens over the same bytes.

Byte offsets where a token of each tokenizer ends are shared cuts; between neighbouring cuts lies a
group of tokens. Cuts are found by divide and conquer: the common end nearest to an interval's
middle, looked up by bisection in the other tokenizer's ends, parts it, both halves go on, and an
interval without one is a leaf, a group. All intervals of a slice of texts go through a round
together. The last tokens of a group end together, which links them; links are counted over the
corpus, and every document is told how common its own are.
"""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import byte_letters
from plumbline.llm.common import text_of, text_slices, written
from plumbline.model import col

# Fixed value: the word pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEAR = 8  # places on either side of the middle that are looked at one by one
SLICE_BYTES = 1 << 20


# ---- divide and conquer


def nearest_cuts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval [lo, hi) of ``a`` the index, the last one aside, of the end that ``b`` shares nearest to the middle, or -1.

    ``a`` and ``b`` are the rising ends of all tokens.
    """
    middle = (lo + hi - 1) // 2
    out = np.full(len(lo), -1)
    todo = np.flatnonzero(hi - lo > 1)
    for step in range(2 * NEAR + 1):
        if not len(todo):
            return out
        at = middle[todo] + (step + 1) // 2 * (1 if step % 2 else -1)
        inside = (at >= lo[todo]) & (at < hi[todo] - 1)
        at = np.where(inside, at, lo[todo])
        place = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
        hit = inside & (b[place] == a[at])
        out[todo[hit]] = at[hit]
        # given up where neither side has places left
        done = hit | (((step + 1) // 2 > middle[todo] - lo[todo]) & ((step + 1) // 2 >= hi[todo] - 1 - middle[todo]))
        todo = todo[~done]
    for i in todo:  # wide intervals without a cut near the middle: all their ends at once
        at = np.arange(lo[i], hi[i] - 1)
        place = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
        at = at[b[place] == a[at]]
        if len(at):
            out[i] = at[np.abs(at - middle[i]).argmin()]
    return out


def groups(a: np.ndarray, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The index in ``a`` of every group's last end, rising; intervals [start, stop) end in shared cuts."""
    lo, hi = starts, stops
    lo, hi = lo[hi > lo], hi[hi > lo]
    leaves = []
    while len(lo):
        cut = nearest_cuts(a, b, lo, hi)
        leaf = cut < 0
        leaves.append(hi[leaf] - 1)
        lo, hi, cut = lo[~leaf], hi[~leaf], cut[~leaf]
        lo, hi = np.concatenate([lo, cut + 1]), np.concatenate([cut + 1, hi])
    return np.sort(np.concatenate(leaves)) if leaves else np.zeros(0, np.int64)


# ---- both tokenizers


@dataclass
class Aligned:
    """A slice of texts: tokens, ends and groups; ``n_a`` and ``n_b`` are 0 for texts that do not align."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    last_a: np.ndarray  # of every group, the index of its last token
    last_b: np.ndarray
    doc: np.ndarray  # of every group


class Tokenizers:
    """A byte-level BPE vocabulary (A) and a piece model (B) in a worker, with the bytes of every token."""

    def __init__(self, byte_spec: str, piece_model: bytes):
        data = json.loads(byte_spec)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in data["added_tokens"]}
        spelt = {bytes(map(byte_of.__getitem__, t)): i for t, i in data["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        made = [spelt[bytes(map(byte_of.__getitem__, "".join(m)))] for m in merges]
        if made != sorted(made):
            raise ValueError("merges are not in the order of their tokens")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=spelt, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.bytes_a = [b""] * (max(spelt.values()) + 1)
        for t, i in spelt.items():
            self.bytes_a[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.n = n
        self.shown = [f"{i}{end}" for end in ",|;" for i in range(n)]  # an id with what follows it

    def most_links(self) -> int:
        """A bound on the pairs of ids that can ever be linked: bytes of one end with all bytes of the other."""
        many_b: dict[bytes, int] = {}
        for t in self.bytes_b:
            many_b[t] = many_b.get(t, 0) + 1
        known_a = set(self.bytes_a)
        short = sum(many_b.get(t[i:], 0) for t in self.bytes_a for i in range(len(t)))
        return short + sum(t[i:] in known_a for t in self.bytes_b for i in range(1, len(t)))

    def align(self, texts: list[str]) -> Aligned:
        want = [(" " + t).encode() if t else b"" for t in texts]
        ids_a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        ids_b = self.b.encode(texts, num_threads=1) if texts else []
        for i, w in enumerate(want):
            if w and not (b"".join(map(self.bytes_a.__getitem__, ids_a[i])) == w == b"".join(map(self.bytes_b.__getitem__, ids_b[i]))):
                w = b""
            if not w:
                ids_a[i], ids_b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (ids_a, ids_b))
        flat_a = np.fromiter(chain.from_iterable(ids_a), np.int64, n_a.sum())
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        stops = np.cumsum(n_a)
        last_a = groups(ends_a, ends_b, stops - n_a, stops)
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        return Aligned(flat_a, flat_b, n_a, n_b, last_a, last_b, np.searchsorted(stops, last_a, side="right"))

    def written_out(self, x: Aligned) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``: A ids, B ids, in order."""
        if not len(x.last_a):
            return [""] * len(x.n_a)
        sizes_a, sizes_b = np.diff(x.last_a, prepend=-1), np.diff(x.last_b, prepend=-1)
        before_b = np.repeat(x.last_b + 1 - sizes_b, sizes_a)  # B tokens that stand before an A token
        before_a = np.repeat(x.last_a + 1, sizes_b)
        order = np.empty(len(x.ids_a) + len(x.ids_b), np.int64)
        ends = np.zeros(len(x.ids_a), np.int64)
        ends[x.last_a] = self.n
        order[np.arange(len(x.ids_a)) + before_b] = x.ids_a + ends
        ends = np.zeros(len(x.ids_b), np.int64)
        ends[x.last_b] = 2 * self.n
        order[np.arange(len(x.ids_b)) + before_a] = x.ids_b + ends
        stops = np.cumsum(x.n_a + x.n_b)
        shown = self.shown.__getitem__
        return ["".join(map(shown, order[stop - n : stop].tolist()))[:-1] for n, stop in zip(x.n_a + x.n_b, stops)]


@lru_cache(maxsize=1)
def tokenizers(byte_spec: str, piece_model: bytes) -> Tokenizers:
    """One pair of tokenizers for all tasks that a worker runs."""
    return Tokenizers(byte_spec, piece_model)


# ---- the corpus


def link_lists(x: Aligned) -> tuple[pa.Array, pa.Array]:
    """Per text its distinct links, A id and B id in one number, and how often each stands there."""
    link = x.ids_a[x.last_a] << 32 | x.ids_b[x.last_b]
    order = np.lexsort((link, x.doc))
    doc, link = x.doc[order], link[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (link[1:] != link[:-1]))) if len(link) else np.zeros(0, np.int64)
    offsets = pa.array(np.searchsorted(doc[first], np.arange(len(x.n_a) + 1)).astype(np.int32))
    times = np.diff(np.append(first, len(link))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(link[first])), pa.ListArray.from_arrays(offsets, pa.array(times))


def align(df: DataFrame, byte_spec: str, piece_model: bytes, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """Per row ``doc``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and its links.

    ``byte_spec`` is the content of a byte-level BPE tokenizer file (A, which gets a space and the
    text), ``piece_model`` that of a piece model (B, which adds the space). Strings of special tokens
    are plain text. ``groups`` is written as ``a1,a2|b1;a3|b2,b3``, or without ``whole`` its SHA-256.
    ``links`` holds the distinct links, A id times 2 ** 32 plus B id, ``times`` how often each stands
    in the text. A text that is null or empty, or whose tokens' joined bytes are not its own,
    has no tokens: zeros, an empty ``groups`` (not digested), no links. Texts of any length are
    aligned whole; repeated rows stay repeated; null ids stay null.
    """
    shared = df.sparkSession.sparkContext.broadcast((byte_spec, piece_model))  # two vocabulary files, about 2 MB
    source = df.select(col(key).alias("doc"), text_of(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(*shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                x = own.align(part.column("text").to_pylist())
                shown = own.written_out(x)
                if not whole:
                    shown = [s and sha256(s.encode()).hexdigest() for s in shown]
                n_groups = np.bincount(x.doc, minlength=part.num_rows)
                columns = [part.column("doc"), pa.array(x.n_a), pa.array(x.n_b), pa.array(n_groups), pa.array(n_groups), pa.array(shown, pa.string()), *link_lists(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"])

    return source.mapInArrow(run, f"doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: how many links of the corpus hold the id pair. At most ``Tokenizers.most_links`` rows."""
    entries = aligned.select(F.explode(F.arrays_zip("links", "times")).alias("e")).groupBy("e.links").agg(F.sum("e.times").alias("n"))
    return entries.select(F.shiftright("links", 32).cast("int").alias("a"), F.col("links").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n")


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` without its links, with ``n_best`` and ``count_sum``.

    The counts are broadcast: two linked tokens end with the same bytes, so the vocabularies bound
    their pairs (324,300 for those of 50,257 and 32,000 tokens), whatever the corpus.
    """
    found = counts.toArrow()
    link = found.column("a").to_numpy().astype(np.int64) << 32 | found.column("b").to_numpy().astype(np.int64)
    n, b = found.column("n").to_numpy(), found.column("b").to_numpy()
    most = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, b, n)
    order = np.argsort(link)
    shared = aligned.sparkSession.sparkContext.broadcast((link[order], n[order], (n == most[b])[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                lists = batch.column("links")
                sizes = lists.value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                at = np.searchsorted(known, lists.flatten().to_numpy())
                times = batch.column("times").flatten().to_numpy().astype(np.int64)
                total, good = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(total, doc, times * n[at])
                np.add.at(good, doc, times * best[at])
                names = ["doc", "n_a", "n_b", "n_groups", "n_links"]
                columns = [batch.column(c) for c in names] + [pa.array(good), pa.array(total), batch.column("groups")]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups"])

    kind = aligned.schema["doc"].dataType.simpleString()
    return aligned.mapInArrow(run, f"doc {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def aligned_documents(df: DataFrame, byte_spec: str, piece_model: bytes, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``align`` with each row's links set against the corpus: ``n_best`` of them have the count that is the
    highest of their B id, ties included; ``count_sum`` adds up the counts of all. Links of the whole
    table count, repeated rows as often as they stand there. An empty table gives no rows; other
    columns of ``df``, whatever their names, play no part.
    """
    aligned = written(align(df, byte_spec, piece_model, key, text, whole), "aligned")
    return with_counts(aligned, link_counts(aligned))
