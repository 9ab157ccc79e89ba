"""Text similarity, abbreviation expansion, chunking, number and code shapes."""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short codes and the long form they stand for.
ABBREVIATIONS = {
    "US": "United States", "USA": "United States", "UK": "United Kingdom", "GB": "United Kingdom", "GBR": "United Kingdom",
    "FR": "France", "FRA": "France", "DE": "Germany", "DEU": "Germany", "GER": "Germany", "ES": "Spain", "ESP": "Spain",
    "IT": "Italy", "ITA": "Italy", "NL": "Netherlands", "NLD": "Netherlands", "CA": "Canada", "CAN": "Canada",
    "MX": "Mexico", "MEX": "Mexico", "JP": "Japan", "JPN": "Japan", "CN": "China", "CHN": "China", "IN": "India",
    "IND": "India", "BR": "Brazil", "BRA": "Brazil", "AU": "Australia", "AUS": "Australia",
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CO": "Colorado", "CT": "Connecticut",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "IL": "Illinois", "MA": "Massachusetts", "MI": "Michigan",
    "NY": "New York", "NC": "North Carolina", "OH": "Ohio", "PA": "Pennsylvania", "TX": "Texas", "VA": "Virginia",
    "WA": "Washington",
}


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = bytearray(len(b))
    hits_a = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), min(len(b), i + reach + 1))
        while j >= 0 and used[j]:
            j = b.find(ch, j + 1, min(len(b), i + reach + 1))
        if j >= 0:
            used[j] = 1
            hits_a.append(ch)
    m = len(hits_a)
    if m == 0:
        return 0.0
    hits_b = [ch for ch, u in zip(b, used) if u]
    half_swaps = sum(x != y for x, y in zip(hits_a, hits_b)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half_swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(levenshtein_similarity(a, b), jaro_winkler(a, b))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient over character bigrams (as multisets) of lower-cased, space-free text."""
    squash = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    x, y = squash(a), squash(b)

    def grams(s):
        return F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(
            F.array().cast("array<string>")
        )

    gx, gy = grams(x), grams(y)
    count = lambda arr, g: F.size(F.filter(arr, lambda e: e == g))
    shared = F.aggregate(F.array_intersect(gx, gy), F.lit(0), lambda acc, g: acc + F.least(count(gx, g), count(gy, g)))
    total = F.size(gx) + F.size(gy)
    return (
        F.when(x == y, 1.0)
        .when((x == "") | (y == ""), 0.0)
        .otherwise(F.coalesce(F.try_divide(2.0 * shared, total), F.lit(0.0)))
    )


def expand_abbreviation(c: Column) -> Column:
    """Long form of a known code, null for anything else."""
    pairs = [F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(c)))


def chunk_words(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Overlapping word chunks as ``array<struct<chunk, words, text>>``; no empty tail chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be between 0 and size")
    step = size - overlap

    def cut(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.cast("long").alias("chunk"),
                F.least(F.lit(size), n - i * step).cast("long").alias("words"),
                F.array_join(F.slice(words, i * step + 1, size), " ").alias("text"),
            ),
        )

    # the outer array binds the words, so a text is split once and not for every chunk
    chunks = F.transform(F.array(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")), cut)[0]
    return F.when(F.trim(text) == "", F.array().cast("array<struct<chunk:bigint,words:bigint,text:string>>")).otherwise(chunks)


def parse_number(c: Column) -> Column:
    """Currency or percent text to a double; null when it is not a number."""
    return F.regexp_replace(F.trim(c), r"[$,%\s]", "").try_cast("double")


def leading_digit(c: Column) -> Column:
    """First significant digit, computed arithmetically (no exponent text)."""
    x = F.abs(c.cast("double"))
    d = F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x))))
    # log10 rounding can push an exact power of ten one step up or down
    return F.when(x > 0, F.when(d >= 10, 1).when(d < 1, 9).otherwise(d)).cast("int")


def npi_valid(c: Column) -> Column:
    """Ten digits whose check digit is right under the 80840 prefix (adds 24 to the Luhn sum)."""
    s = c.cast("string")
    digits = F.transform(F.split(F.when(s.rlike(r"^\d{10}$"), s), ""), lambda d: d.try_cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())

    def weigh(d, i):
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(digits, weigh), F.lit(24), lambda acc, d: acc + d)
    return F.coalesce(s.rlike(r"^\d{10}$") & (total % 10 == 0), F.lit(False))


# Code shapes.
CPT_SHAPE = r"^(\d{5}|[A-Z]\d{4})$"
ICD10_SHAPE = r"^[A-TV-Z]\d[0-9A-Z](\.?[0-9A-Z]{1,4})?$"


def cpt_shaped(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c.cast("string"))).rlike(CPT_SHAPE), F.lit(False))


def icd10_shaped(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c.cast("string"))).rlike(ICD10_SHAPE), F.lit(False))


def _max_edits(longest: int, threshold: float) -> int:
    """Most edits at which 1 - edits/longest still reaches the threshold."""
    return int(np.floor((1 - threshold) * longest + 1e-9))


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    base, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (1 if i >= parts - extra else 0)
        out.append((at, size))
        at += size
    return out


def edit_signatures(s: str, threshold: float, probe: bool) -> set[str]:
    """Pairs of segments (or, as a probe, substrings) of which any pair within the threshold shares one.

    A string cut into d+2 segments keeps at least two intact under d edits, each moved by at
    most d places. The shorter string is indexed; a string probes every shorter length.
    """
    out: set[str] = set()
    n = len(s)
    lengths = range(max(1, n - _max_edits(n, threshold)), n + 1) if probe else [n]
    for length in lengths:
        longest = length
        while longest + 1 - length <= _max_edits(longest + 1, threshold):
            longest += 1
        d = _max_edits(longest, threshold)
        parts = _segments(length, min(d + 2, length))
        moves = range(-d, d + 1) if probe else (0,)
        pieces = []
        for start, size in parts:
            here = {k: s[start + k : start + k + size] for k in moves if start + k >= 0}
            pieces.append({k: x for k, x in here.items() if len(x) == size})
        if length < d + 2:  # too short for two intact segments: one may be all that is left
            out.update(f"e{length}.{i}.{x}" for i, p in enumerate(pieces) for x in p.values())
            continue
        for i, j in combinations(range(len(parts)), 2):
            out.update(f"e{length}.{i}.{j}.{x}.{y}" for k, x in pieces[i].items() for m, y in pieces[j].items() if abs(k - m) <= d)
    return out


# Shared-prefix lengths handled together: (characters that must agree, prefix length of the looser bound).
_PREFIX_CLASSES = ((0, 0), (1, 3), (4, 4))
# Letters from common to rare.
_COMMON = " eaionrtslcudpmhgbyfvkwzxqj"


def jaro_signatures(s: str, threshold: float, probe: bool) -> set[str]:
    """Pairs of rare character tokens of which any pair above the Jaro-Winkler threshold shares one.

    A shared prefix of length p and the threshold give a least number of common characters.
    With all tokens in one rare-first order, two strings with that many in common share at
    least two tokens among the first few of each. The shorter string is indexed under its
    own length; a string probes every length a shorter partner can have.
    """
    n = len(s)
    seen: dict[str, int] = {}
    tokens = []
    for ch in s:
        seen[ch] = seen.get(ch, 0) + 1
        tokens.append((ch, seen[ch]))
    tokens.sort(key=lambda t: (-t[1], -(_COMMON.find(t[0].lower()) % 99), t[0]))
    out: set[str] = set()
    for agree, p in _PREFIX_CLASSES:
        if agree > n:
            break
        least = 3 * (threshold - 0.1 * p) / (1 - 0.1 * p) - 1
        for short in range(max(1, agree, int(n * (least - 1))), n + 1) if probe else (n,):
            floor = max(1, int(np.ceil(least * short / 2 - 1e-9)))
            need = max(floor, int(np.ceil(least * short * n / (short + n) - 1e-9)))
            if need > short:
                continue
            size = min(2, floor)
            tag = f"j{agree}.{short}.{s[:agree]}."
            out.update(tag + "".join(f"{c}{i}" for c, i in pick) for pick in combinations(tokens[: n - need + size], size))
    return out


def signatures(threshold: float, probe: bool, metric: str = "both"):
    """Vectorised signature arrays for the candidate join."""

    @F.pandas_udf("array<long>")
    def make(values: pd.Series) -> pd.Series:
        import xxhash

        rows = []
        for v in values:
            keys: set[str] = set()
            if metric in ("both", "levenshtein"):
                keys |= edit_signatures(v, threshold, probe)
            if metric in ("both", "jaro_winkler"):
                keys |= jaro_signatures(v, threshold, probe)
            rows.append([xxhash.xxh64_intdigest(k) - 2**63 for k in keys])
        return pd.Series(rows)

    return make
