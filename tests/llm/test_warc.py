"""The chunked record table and its archives: round trips, segments, foreign archives."""
from __future__ import annotations

import glob
import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import warc
from plumbline.session import run_folder

SCHEMA = "page_id long, url string, html string, key string, record long, chunk int, data string, salt int, total long, value string"


def page_rows() -> list[tuple]:
    long = "".join(f"<p>paragraph {i} é\r\n\r\nWARC/1.1\r\n</p>" for i in range(4000))
    base = [
        (1, "http://a.example.com/1", "x" * 1000),
        (2, "http://a.example.com/ 2\r\nWARC-Type: evil", "x" * 1000),
        (3, None, "x" * 999),
        (4, "http://a.example.com/4", "x" * 999),
        (5, "http://a.example.com/5", None),
        (6, "http://a.example.com/6", ""),
        (7, "http://a.example.com/7", long),
        (8, "http://a.example.com/8", "\r\n\r\n"),
        (9, "http://a.example.com/9", "ends so\r\n"),
        (10, "http://a.example.com/10", "\r\nHTTP/1.1 200 OK\r\n\r\nx\r"),
        (None, "http://a.example.com/none", "x" * 1000),
        (11, "http://a.example.com/11", "é" * 500),
        (11, "http://a.example.com/11", "é" * 500),
        (12, "http://a.example.com/12", long),
    ]
    return [(*r, "k", 5, 6, "d", 1, 2, "v") for r in base]


def plain(rows: list[tuple]) -> Counter:
    data = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    best: dict[bytes, int] = {}
    for i, (p, b) in enumerate(data):
        if len(b) >= 1000 and (b not in best or (data[best[b]][0] or -1) < (p or -1)):
            best[b] = i
    return Counter(
        (p, len(b), hashlib.sha1(b).hexdigest(), *(("response", None) if best.get(b, i) == i else ("revisit", data[best[b]][0])), True) for i, (p, b) in enumerate(data)
    )


def found(df) -> Counter:
    return Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 20, 1000, 7])
def test_round_trip(spark, chunk):
    rows = page_rows() if chunk > 7 else [r for r in page_rows() if r[0] not in (7, 12)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(warc.archived_pages(df, chunk=chunk)) == plain(rows)


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_and_files(spark):
    """The payloads come back chunk by chunk, and the files are records that follow each other."""
    rows = page_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    path = run_folder(spark, "warc-test")
    warc.archived_pages(df, path=path, chunk=5000)
    chunks = warc.read_chunks(spark, path, chunk=700).collect()
    assert all(len(r.data) <= 700 for r in chunks) and all(r.whole for r in chunks)
    payloads: dict[str, bytearray] = {}
    for r in sorted(chunks, key=lambda r: (r.record, r.chunk)):
        own = payloads.setdefault(r.record, bytearray())
        own += r.data
        assert (r.bytes, r.sha1) == (len(own), hashlib.sha1(own).hexdigest())
    got = Counter(bytes(v) for v in payloads.values())
    stored = Counter((h or "").encode() for p, _, h, *_ in rows)
    assert +got == +Counter({b: 1 if len(b) >= 1000 else n for b, n in stored.items()} | {b"": got[b""]})
    assert got[b""] == 2 + sum(n - 1 for b, n in stored.items() if len(b) >= 1000)  # empty payloads and revisits
    kinds = Counter()
    for name in glob.glob(path.removeprefix("file:") + "/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds[fields["WARC-Type"]] += 1
            data = rest[n + 4 :]
    assert kinds["response"] + kinds["revisit"] == len(rows) and kinds["continuation"] > 10


def record(name: str, kind: str, block: bytes, **more) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members compressed one by one, other content types, segments in several files and out of order, a missing segment."""
    rng = np.random.default_rng(2)
    binary = rng.integers(0, 256, 5000).astype(np.uint8).tobytes()
    one = [
        record("<a>", "warcinfo", b"software: x\r\n"),
        record("<b>", "resource", binary),
        record("<c>", "response", b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n" + binary[:100], Content_Type="application/http"),
        record("<d>", "response", b"no head at all", Content_Type="application/http"),
        record("<e3>", "continuation", b"three", WARC_Segment_Number=3, WARC_Segment_Origin_ID="<e>", WARC_Segment_Total_Length=12),
        record("<f>", "resource", b"only the first", WARC_Segment_Number=1),
        record("<g>", "resource", b"first", WARC_Segment_Number=1),
    ]
    two = [
        record("<e2>", "continuation", b"two", WARC_Segment_Number=2, WARC_Segment_Origin_ID="<e>"),
        record("<e>", "resource", b"one ", WARC_Segment_Number=1),
        record("<g3>", "continuation", b"third", WARC_Segment_Number=3, WARC_Segment_Origin_ID="<g>", WARC_Segment_Total_Length=15),
    ]
    for name, records in (("one", one), ("two", two)):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = {r.record: (r.bytes, r.sha1) for r in warc.read_records(spark, str(tmp_path), chunk=64).collect()}
    want = {"<a>": b"software: x\r\n", "<b>": binary, "<c>": binary[:100], "<d>": b"no head at all", "<e>": b"one twothree"}
    assert got == {k: (len(v), hashlib.sha1(v).hexdigest()) for k, v in want.items()}


def test_cut_off_archive(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record("<a>", "resource", b"x" * 100)[:-60]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, str(tmp_path)).collect()
