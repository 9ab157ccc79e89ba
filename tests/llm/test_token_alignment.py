"""Cross-tokenizer alignment against both libraries and sets of ends."""
from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import queries, token_alignment
from plumbline.llm.bpe import byte_letters

LONG = " ".join(f"w{i % 700}x{i}é" for i in range(20_000))


def rows() -> list[tuple]:
    texts = [
        None, "", " ", "hello world", "  two  spaces\n\nand lines\t.", "<|endoftext|> <s> </s> <0x41> <unk>", "▁under", "naïve café 😀 漢字 İstanbul", LONG,
        "aaaa" * 500, " " * 300, "\x00\x01", "áé", "ﬁn №5", "hello world", "tab\tend ", "don't we'll I'M", "x" * 3000 + " " + "1" * 999,
    ]
    return [(i if i else None, t, "k", 1, "g", 2, "l") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, groups string, n_a int, links string, n int, doc string"


@pytest.fixture(scope="module")
def specs():
    return queries.tokenizer_file("byte_bpe_50k.json").decode(), queries.tokenizer_file("piece_bpe_32k.model")


def plain(specs, data: list[tuple]) -> list[tuple]:
    """What the tokenizers' own libraries and intersections of sets give."""
    tokenizers = pytest.importorskip("tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    t = tokenizers.Tokenizer.from_str(specs[0])
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_proto=specs[1])
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    names = {i: bytes(byte_of[c] for c in x) for x, i in json.loads(specs[0])["model"]["vocab"].items() if x != "<|endoftext|>"}
    piece = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for doc, text in data:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(names[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            docs.append((doc, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(names[i]) for i in a]).tolist(), np.cumsum([len(piece(i)) for i in b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = [ends_a.index(c) for c in cuts] if len(cuts) < 300 else np.searchsorted(ends_a, cuts).tolist(), np.searchsorted(ends_b, cuts).tolist()
        links = [(a[i], b[j]) for i, j in zip(at_a, at_b)]
        count.update(links)
        parts, i0, j0 = [], 0, 0
        for i, j in zip(at_a, at_b):
            parts.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        docs.append((doc, a, b, [parts, links]))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc, a, b, more in docs:
        parts, links = more or ([], [])
        out.append((doc, len(a), len(b), len(parts), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), ";".join(parts)))
    return out


def found(df) -> Counter:
    return Counter((r.doc, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def test_against_libraries(spark, specs):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    want = plain(specs, [r[:2] for r in data])
    assert sum(not r[1] for r in want) >= 3 and sum(bool(r[1]) for r in want) >= 10
    assert found(token_alignment.aligned_documents(df, *specs)) == Counter(want)
    short = found(token_alignment.aligned_documents(df, *specs, whole=False))
    assert short == Counter((*r[:-1], r[-1] and hashlib.sha256(r[-1].encode()).hexdigest()) for r in want)


def test_empty_table(spark, specs):
    assert token_alignment.aligned_documents(spark.createDataFrame([], SCHEMA), *specs).collect() == []
    none = token_alignment.aligned_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *specs).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query(spark, specs):
    root = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in queries.QUERIES["op11_alignment"](spark, root).collect())
    assert got == Counter((*r[:-1], r[-1] and hashlib.sha256(r[-1].encode()).hexdigest()) for r in plain(specs, data))


def test_groups():
    """Divide and conquer against the intersection of the ends, also where cuts are rare or far from the middle."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 400):
        for share in (0.02, 0.3, 0.9):
            ends = np.arange(1, 3 * n + 1)
            a, b = (ends[(rng.random(3 * n) < share) | (ends == 3 * n)] for _ in "ab")
            got = token_alignment.groups(a, b, np.array([0]), np.array([len(a)]))
            assert a[got].tolist() == np.intersect1d(a, b).tolist()
    a, b = np.arange(2, 6001, 2), np.append(np.append(4, np.arange(5, 6000, 2)), 6000)
    assert a[token_alignment.groups(a, b, np.array([0]), np.array([len(a)]))].tolist() == [4, 6000]


def test_bound_of_links(specs):
    own = token_alignment.tokenizers(*specs)
    assert own.most_links() < 600_000
    text = LONG[:100_000]
    x = own.align([text])
    for i, j in zip(x.ids_a[x.last_a], x.ids_b[x.last_b]):
        one, two = own.bytes_a[i], own.bytes_b[j]
        assert one.endswith(two) or two.endswith(one)
