"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie. Walking it depth first, every node gets the last
token of the encoding of its prefix: the one suffix token that is compatible with the last token
of what stands before it. The encoding of a word is then read back from its end, and the part of
the trie that words share is computed once. Two tokens are compatible when no merge ever crosses
the border between them.
"""
from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import returned, text_of, text_slices
from plumbline.model import col

END = "</w>"
LATIN = "À-ÖØ-öø-ɏ"  # letters, all of them
MARK = "\ud800"  # before a special token; no text can hold it
# The white space of the tokenizer's pattern library.
SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
# Letters and numbers newer than the tokenizer's pattern library (Unicode 16), and the lower
# case of letters that came with Unicode 16 and 17, as first letter, last letter, distance.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
LOWER = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0x16EA0, 0x16EB8, 27))


def word_pattern() -> str:
    """The word pattern of the vocabulary: contractions, runs of letters, single numbers, runs of the rest."""
    newer = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split())
    return f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}--[{newer}]]+|[\\p{{N}}--[{newer}]]|[[^{SPACE}\\p{{L}}\\p{{N}}][{newer}]]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairRules:
    """Merge ranks, and whether two tokens can stand side by side in an encoding."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], max_pairs: int):
        self.vocab, self.max_pairs = vocab, max_pairs
        self.names = {i: t for t, i in vocab.items()}
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        for i, (a, b) in enumerate(merges):
            whole = a + b
            if whole in self.parts or self.born.get(a, -1) >= i or self.born.get(b, -1) >= i:
                raise ValueError(f"merge {i} ({a} {b}) comes before its parts or makes a token twice")
            self.parts[whole] = (a, b)
            self.born[whole] = i
        for a, b in merges:
            if any(x not in self.born and len(x.removesuffix(END)) > 1 for x in (a, b)):
                raise ValueError(f"merge of {a} {b} uses a token that no merge makes")
        self.known_pairs: dict[int, bool] = {}
        self._whole: dict[str, bool] = {}

    def _spine(self, token: str, side: int) -> list[str]:
        """The pieces that touch one end of a token while it is being merged, smallest first."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def _crossing(self, left: str, right: str) -> tuple[str, str] | None:
        """The first merge over the border of two tokens that grow side by side, if there is one."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        never = len(self.rank)
        while True:
            cross = self.rank.get((a[i], b[j]), never + 1)
            grow_a = self.born[a[i + 1]] if i + 1 < len(a) else never
            grow_b = self.born[b[j + 1]] if j + 1 < len(b) else never
            # of equal merges the leftmost goes first: the left token's own, the border, the right token's own
            if cross < grow_a and cross <= grow_b:
                return a[i], b[j]
            if grow_a == grow_b == never:
                return None
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def reachable(self, token: str) -> bool:
        """Whether the letters of a token are encoded as this token."""
        known = self._whole.get(token)
        if known is None:
            known = token in self.vocab
            if known and token in self.parts:
                a, b = self.parts[token]
                known = self.reachable(a) and self.reachable(b) and self._crossing(a, b) == (a, b)
            self._whole[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens, by id, can follow each other."""
        pair = left << 32 | right
        known = self.known_pairs.get(pair)
        if known is None:
            if len(self.known_pairs) >= self.max_pairs:
                self.known_pairs.clear()
            known = self.known_pairs[pair] = self._crossing(self.names[left], self.names[right]) is None
        return known


class PrefixTrie:
    """Words by shared prefix; ``last[node]`` is the last token of the encoding of the node's prefix."""

    def __init__(self, rules: PairRules, max_nodes: int):
        self.rules, self.max_nodes = rules, max_nodes
        usable = {t: i for t, i in rules.vocab.items() if rules.reachable(t)}
        self.inner = {t: i for t, i in usable.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in usable.items() if t.endswith(END)}
        self.length = {i: len(t.removesuffix(END)) for t, i in usable.items()}
        self.longest = max(self.length.values())
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}  # node and letter to node; letters are below 512
        self.last = [-1]

    def _last_token(self, word: str, end: int, tokens: dict[str, int], path: list[int]) -> int:
        """The suffix token of ``word[:end]`` compatible with the state before it; ``path[i]`` is the node of i letters."""
        # exactly one token fits, so the order is free: short ones are likely in words not met before
        last, known, compatible, get = self.last, self.rules.known_pairs, self.rules.compatible, tokens.get
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            token = get(word[start:end])
            if token is None:
                continue
            if not start:
                return token
            left = last[path[start]]
            fits = known.get(left << 32 | token)
            if fits or fits is None and compatible(left, token):
                return token
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of every word. Sorted words visit the trie depth first."""
        if len(self.last) > self.max_nodes:
            self.clear()
        out = {}
        path = [0]
        before = ""
        for word in sorted(words):
            end = len(word) - 1
            shared, most = 0, min(end, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared, end):
                step = path[-1] << 9 | ord(word[depth])
                node = self.below.get(step)
                if node is None:
                    node = self.below[step] = len(self.last)
                    self.last.append(self._last_token(word, depth + 1, self.inner, path))
                path.append(node)
            before = word[:end]
            token = self._last_token(word, end + 1, self.final, path)
            tokens, left = [token], end + 1 - self.length[token]
            while left:
                token = self.last[path[left]]
                tokens.append(token)
                left -= self.length[token]
            out[word] = tokens[::-1]
        return out


class Codec:
    """One vocabulary in a task. Words are encoded once and kept, up to a bound."""

    def __init__(self, spec: str, max_words: int = 120_000, max_nodes: int = 150_000, max_pairs: int = 150_000):
        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.trie = PrefixTrie(PairRules(self.vocab, merges, max_pairs), max_nodes)
        self.max_words = max_words
        self.known: dict[str, list[int]] = {}
        self.letters = byte_letters()
        self.find = regex.compile(word_pattern(), regex.V1).findall
        self.lower = {c: c + d for a, b, d in LOWER for c in range(a, b + 1)} | {ord("Σ"): "σ"}
        self.unusual = re.compile(f"[^\\0-\\x7f{LATIN}]").search
        self.find_latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\t-\r a-z{LATIN}0-9]+").findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """Normalised text in words; special tokens, marked, stand for themselves."""
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            return [w for i, p in enumerate(parts) for w in ([MARK + p] if i % 2 else self.words(p))]
        plain = text if text.isascii() else unicodedata.normalize("NFC", text)
        plain = plain.lower() if not self.unusual(plain) else plain.translate(self.lower).lower()
        return (self.find if self.unusual(plain) else self.find_latin)(plain)

    def learn(self, words: set[str]) -> None:
        """Encode the words not seen yet."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.max_words:
            self.known.clear()
            new = words
        spelt = {w: w if w.isascii() and w.isalpha() else "".join(map(self.letters.__getitem__, w.encode())) for w in new if w[0] != MARK}
        ids = self.trie.encode(list(spelt.values()))
        for w in new:
            self.known[w] = [self.special[w[1:]]] if w[0] == MARK else ids[spelt[w]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the vocabulary names no decoder. Unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join(self.names[i] for i in ids if i in self.names)


def encode(df: DataFrame, spec: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """``ids`` (array of int) of every text, and ``decoded``, the text made from those ids.

    ``spec`` is the content of a tokenizer file (word-end BPE over byte letters). A null or empty
    text has no ids and decodes to the empty text. Special tokens in a text are taken as such. A
    very long text is encoded whole; repeated rows stay repeated. Returns ``keep``, ids, decoded.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(spec)  # one vocabulary file, about 2 MB
    kept = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[col(k).alias(a) for k, a in zip(keep, kept)], text_of(text).alias("text"))
    types = ", ".join(f"{a} {source.schema[a].dataType.simpleString()}" for a in kept)
    schema = f"{types}{', ' if kept else ''}ids array<int>" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made for the task and gone with it: workers wait beside other stages, each with all it has kept
        own = None
        for batch in batches:
            own = own or Codec(shared.value)
            for part in text_slices(batch, "text", 2 << 20):
                ids = own.encode(part.column("text").to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
                columns = [part.column(a) for a in kept] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", *["decoded"] * decoded])

    out = source.mapInArrow(lambda batches: returned(run(batches)), schema)
    return out.select(*[F.col(a).alias(k) for k, a in zip(keep, kept)], "ids", *["decoded"] * decoded)


def digests(encoded: DataFrame) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of its decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
