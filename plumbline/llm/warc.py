"""WARC archives as a chunked record table.

A payload of any size is handled as rows (record, chunk number, at most ``chunk`` bytes), in order,
each with the number of bytes and the SHA-1 of the payload up to its end. Writing turns every row
into one WARC record, an oversized payload into a first segment and its continuation records, so
neither side allocates a whole record. Reading parses the archives as streams of bytes into the
same kind of rows. Payloads that were stored before are written as revisit records.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.model import col
from plumbline.session import run_folder

CHUNK = 1 << 20
LEAST_BYTES = 1000
SALTS = 16
MOST_HEADER = 1 << 20
# The line ends and the profile name of the format.
END, BLANK = "\r\n", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- writing


def _upto(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bytes and SHA-1 of each payload up to the end of every chunk; a record's chunks come in order."""
    total, digest = 0, hashlib.sha1()
    for chunks, data in parts:
        sizes, digests = [], []
        for number, part in zip(chunks.to_pylist(), data):
            if not number:
                total, digest = 0, hashlib.sha1()
            part = part.as_buffer()
            digest.update(part)
            total += part.size
            sizes.append(total)
            digests.append(digest.hexdigest())
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["bytes", "sha1"])


def chunk_rows(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The record table: ``record``, ``key``, ``url``, ``chunk``, ``data``, ``bytes``, ``sha1``, ``last``.

    A null or empty payload has one empty chunk. ``bytes`` and ``sha1`` are those of the payload up to
    the chunk's end, so the row with ``last`` carries them for the whole. ``record`` numbers the rows
    of ``df``: write the table down before it is used twice.
    """
    body = F.coalesce(col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.monotonically_increasing_id().alias("record"), col(key).alias("key"), col(url).cast("string").alias("url"), body.alias("body"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("body") / chunk).cast("int") - 1)
    parts = rows.withColumn("final", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), "final")))
    cut = parts.select(
        "record", "key", "url", "chunk", F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"), (F.col("chunk") == F.col("final")).alias("last")
    )
    upto = F.arrow_udf(_upto, "struct<bytes long, sha1 string>")
    return cut.withColumn("_upto", upto("chunk", "data")).select("record", "key", "url", "chunk", "data", "_upto.bytes", "_upto.sha1", "last")


def decide(chunks: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per record: ``record``, ``bytes``, ``sha1`` and ``origin``, the record that it revisits, or null.

    Of equal payloads (same SHA-1 and length) of ``least_bytes`` or more the one with the largest key
    is stored, null keys smallest, then the largest record number. The copies of one payload are
    dealt over ``SALTS`` parts, so a payload that fills much of the table is in no single task.
    """
    whole = chunks.where("last").select("record", "key", "bytes", "sha1")
    copies = whole.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "record")).alias("best"))
    stored = copies.where("n > 1").select("sha1", "bytes", F.col("best.record").alias("stored"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int"))
    joined = salted.join(stored.hint("merge"), ["sha1", "bytes", "salt"], "left")
    return joined.select("record", "bytes", "sha1", F.when(F.col("stored") != F.col("record"), F.col("stored")).alias("origin"))


def record_urn(record: Column, segment: Column | None = None) -> Column:
    """A name made from the record's number, the same whenever it is made."""
    name = record.cast("string") if segment is None else F.concat_ws("-", record, segment)
    h = F.md5(F.concat(F.lit("warc-"), name).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record_texts(rows: DataFrame, date: str) -> Column:
    """A row of the record table, with ``total`` and ``origin``, as one WARC record without the line ends after it."""
    first, segmented = F.col("chunk") == 0, F.col("total") > F.when(F.col("chunk") == 0, F.octet_length("data")).otherwise(-1)
    revisit = F.col("origin").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("total").cast("string"), F.lit(BLANK))
    head = F.when(first, http).otherwise("")
    data = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    uri = F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    cut = segmented & ~revisit
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    lines = [
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, record_urn(F.col("record"))).otherwise(record_urn(F.col("record"), F.col("chunk")))),
        line("WARC-Date", F.lit(date)),
        F.when(first, line("WARC-Target-URI", uri)),
        F.when(first, line("WARC-Record-Key", F.url_encode(F.col("key").cast("string")))),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))),
        F.when(revisit, line("WARC-Profile", F.lit(SAME_PAYLOAD))),
        F.when(revisit, line("WARC-Refers-To", record_urn(F.col("origin")))),
        F.when(cut, line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"))),
        F.when(cut & ~first, line("WARC-Segment-Origin-ID", record_urn(F.col("record")))),
        F.when(cut & ~first & F.col("last"), line("WARC-Segment-Total-Length", (F.col("total") + F.octet_length(http)).cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(head) + F.octet_length(data)).cast("string")),
        F.lit(END),
        head,
    ]
    text = F.concat(*[F.coalesce(x, F.lit("")) for x in lines])
    return F.concat(text.cast("binary"), data).cast("string")  # the bytes as they are


def write_archives(chunks: DataFrame, decided: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the record table as gzip-compressed WARC files, the records of a task in one file.

    A revisit record has the headers of its page, the payload's digest and length, and the name of
    the record that holds the payload. The chunks of a payload stand behind each other as segments.
    Spaces and line ends in a url are percent-encoded; a null url or key has no line.
    """
    known = decided.select("record", F.col("bytes").alias("total"), F.col("sha1").alias("digest"), "origin")
    rows = chunks.drop("bytes", "sha1").join(known.hint("merge"), "record").where("origin is null or chunk = 0")
    ordered = rows.sortWithinPartitions("record", "chunk")
    ordered.select(record_texts(ordered, date).alias("value")).write.option("lineSep", BLANK).option("compression", "gzip").text(path)


# ---- reading


@dataclass
class Parser:
    """One archive as a stream: bytes in, chunks out. Holds a header or a chunk at a time."""

    chunk: int
    emit: Callable[[Parser, bytes, bool], None]  # a chunk's data, and whether its block ends there
    buffer: bytearray = field(default_factory=bytearray)
    left: int = -1  # bytes of the block to come; -1 inside a header
    http: bool = False  # inside the head of an HTTP message
    http_length: int | None = None
    # the payload being read: the header of its first segment, its name, and what has been read of it
    first: dict = field(default_factory=dict)
    record: str = ""
    segment: int = 1
    in_order: bool = True  # from the first segment on, each behind the other
    ends: bool = True  # the payload ends with this block
    expected: tuple = ()  # record and segment that would go on with it
    digest: object = None
    total: int = 0
    number: int = 0

    def feed(self, data: memoryview) -> None:
        while len(data):
            if self.left < 0:
                data = self._in_header(data)
            else:
                part, data = data[: self.left], data[self.left :]
                self.left -= len(part)
                self._in_block(part)
                if not self.left:
                    self._end_block()

    def close(self) -> None:
        """The end of a file: only line ends may be left over."""
        if self.left >= 0 or self.buffer.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")
        self.buffer.clear()
        self.expected = ()

    def _in_header(self, data: memoryview) -> memoryview:
        before = len(self.buffer)
        self.buffer += data[:MOST_HEADER]
        start = 0
        while start < len(self.buffer) and self.buffer[start] in b"\r\n":
            start += 1
        end = self.buffer.find(b"\r\n\r\n", start)
        if end < 0:
            if len(self.buffer) > MOST_HEADER:
                raise ValueError("no end of a record's header")
            return data[MOST_HEADER:]
        lines = bytes(self.buffer[start:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"a record starts with {lines[0][:40]!r}")
        self.buffer.clear()
        self._start_block({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])})
        return data[end + 4 - before :]

    def _start_block(self, header: dict) -> None:
        self.left = int(header["content-length"])
        self.segment = int(header.get("warc-segment-number", 1))
        self.record = header.get("warc-segment-origin-id", header.get("warc-record-id", ""))
        goes_on = (self.record, self.segment) == self.expected
        self.in_order = self.segment == 1 or goes_on
        if not goes_on:
            self.first, self.digest, self.total, self.number, self.http_length = header, hashlib.sha1(), 0, 0, None
        self.http = self.segment == 1 and header.get("content-type", "").startswith("application/http")
        self.ends = "warc-segment-number" not in header or "warc-segment-total-length" in header
        self.expected = (self.record, self.segment + 1) if self.in_order and not self.ends else ()
        if not self.left:
            self._end_block()

    def _in_block(self, part: memoryview) -> None:
        if self.http:
            self.buffer += part
            end = self.buffer.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.buffer[:end]).decode("utf-8", "replace").lower().split("\r\n")
            length = next((x.partition(":")[2].strip() for x in lines if x.startswith("content-length:")), "")
            self.http_length = int(length) if length.isdigit() else None
            rest = bytes(self.buffer[end + 4 :])
            self.buffer.clear()
            self.http = False
            self._in_payload(memoryview(rest))
        else:
            self._in_payload(part)

    def _in_payload(self, part: memoryview) -> None:
        while len(part):
            # a full chunk goes out when more comes, so the last one of a block is known as such
            if len(self.buffer) == self.chunk:
                self._out(False)
            room = self.chunk - len(self.buffer)
            self.buffer += part[:room]
            part = part[room:]

    def _out(self, block_ends: bool) -> None:
        self.digest.update(self.buffer)
        self.total += len(self.buffer)
        self.emit(self, bytes(self.buffer), block_ends)
        self.number += 1
        self.buffer.clear()

    def _end_block(self) -> None:
        if self.http:  # no HTTP head after all
            self.http = False
            rest = bytes(self.buffer)
            self.buffer.clear()
            self._in_payload(memoryview(rest))
        self._out(True)
        self.left = -1


CHUNK_SCHEMA = (
    "record string, type string, key string, uri string, refers_to string, declared string, declared_bytes long, "
    "segment int, chunk int, data binary, bytes long, sha1 string, last boolean, whole boolean"
)


def _archive_rows(spark: SparkSession, path: str, chunk: int, data: bool, only_last: bool) -> DataFrame:
    """Rows of the archives under ``path``: every chunk, or ``only_last`` of each payload and of each segment that lies apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def emit(p: Parser, part: bytes, block_ends: bool) -> None:
            nonlocal size
            if only_last and not (block_ends and (p.ends or not p.in_order)):
                return
            h = p.first
            stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            named = [h.get(n) for n in ("warc-type", "warc-record-key", "warc-target-uri", "warc-refers-to")]
            rows.append((p.record, *named, stated, p.http_length, p.segment, p.number, part if data else None, p.total, p.digest.hexdigest(), block_ends and p.ends, p.in_order))
            size += len(part) * data + 300

        def batch() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))
            rows.clear()
            size = 0
            return out

        text, big, small, yes = pa.string(), pa.int64(), pa.int32(), pa.bool_()
        kinds = dict(record=text, type=text, key=text, uri=text, refers_to=text, declared=text, declared_bytes=big, segment=small, chunk=small, data=pa.binary(), bytes=big, sha1=text, last=yes, whole=yes)
        file, parser = None, Parser(chunk, emit)
        for part in batches:
            for name, value in zip(part.column("file"), part.column("value")):
                if name != file:
                    parser.close()
                    file = name
                parser.feed(memoryview(value.as_buffer()))
                parser.feed(memoryview(b"\r\n\r\n"))
                if size > 4 << 20:
                    yield batch()
        parser.close()
        yield batch()

    lines = spark.read.option("lineSep", BLANK).text(path)
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return named.mapInArrow(run, CHUNK_SCHEMA)


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The archives under ``path`` as chunk rows, a file read as one stream by one task.

    ``record`` is the name of the record, for segments that of the first; ``chunk`` numbers the
    chunks of a run of segments that stand behind each other, ``bytes`` and ``sha1`` are those of
    the run up to the chunk's end. ``whole`` says that the run starts at the first segment, ``last``
    that the payload ends here. ``declared`` and ``declared_bytes`` are the digest and the HTTP
    length that the record states. Files must be compressed (gzip) or of one split each. Memory:
    a chunk, and what stands between two empty lines of the file (at most a segment if it was
    written here).
    """
    return _archive_rows(spark, path, chunk, True, False)


def read_records(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Per record of the archives under ``path``: ``record``, ``type``, ``key``, ``uri``, ``refers_to``,
    ``declared``, ``declared_bytes``, ``bytes``, ``sha1`` (of the payload as it was read).

    Segments behind each other are digested as they are read. Where a record's segments lie apart,
    its chunks are sorted by segment and digested in that order; an incomplete one is left out.
    """
    runs = written(_archive_rows(spark, path, chunk, False, True), "warc-runs")
    fields = ["record", "type", "key", "uri", "refers_to", "declared", "declared_bytes", "bytes", "sha1"]
    whole = runs.where("whole and last").select(*fields)
    apart = runs.where("not whole").select("record").distinct()
    if apart.isEmpty():
        return whole
    chunks = read_chunks(spark, path, chunk).join(apart, "record", "left_semi").repartition("record").sortWithinPartitions("record", "segment", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, digest, total, segment = None, None, 0, 0
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i] for n in ("record", "segment", "last")}
                if first is None or first["record"] != r["record"].as_py():
                    first = {n: batch.column(n)[i].as_py() for n in fields}
                    digest, total, segment = hashlib.sha1(), 0, 0
                at = r["segment"].as_py()
                segment = at if segment in (at, at - 1) else 1 << 30  # a segment is missing
                part = batch.column("data")[i].as_buffer()
                digest.update(part)
                total += part.size
                if r["last"].as_py() and segment < 1 << 30:
                    found.append([*[first[n] for n in fields[:-2]], total, digest.hexdigest()])
            columns = list(zip(*found)) if found else [[] for _ in fields]
            kinds = [pa.int64() if n in ("declared_bytes", "bytes") else pa.string() for n in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=fields)

    types = ", ".join(f"{n} {'long' if n in ('declared_bytes', 'bytes') else 'string'}" for n in fields)
    return whole.unionByName(chunks.mapInArrow(run, types))


def resolved(records: DataFrame) -> DataFrame:
    """Per page record: ``key``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (a key), ``intact``.

    A revisit has the length and the digest that it states for the payload stored elsewhere;
    ``intact`` says whether what was read, or for a revisit the record it refers to, has the stated
    digest and length. Revisits of one record are dealt over ``SALTS`` parts.
    """
    revisits = records.where("type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int"))
    asked = revisits.select("refers_to").distinct()
    held = records.where("type = 'response'").select(F.col("record").alias("refers_to"), F.col("key").alias("goal"), F.col("sha1").alias("goal_sha1"), F.col("bytes").alias("goal_bytes"))
    goals = held.join(asked.hint("merge"), "refers_to", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("goal_sha1") == F.col("declared")) & (F.col("goal_bytes") == F.col("declared_bytes"))
    again = revisits.join(goals.hint("merge"), ["refers_to", "salt"], "left").select(
        "key", F.col("declared_bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.col("type").alias("record_type"), F.col("goal").alias("refers_to"),
        F.coalesce(same, F.lit(False)).alias("intact"),
    )
    here = F.coalesce(F.col("sha1") == F.col("declared"), F.lit(True)) & F.coalesce(F.col("bytes") == F.col("declared_bytes"), F.lit(True))
    stored = records.where("type = 'response'").select(
        "key", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), here.alias("intact")
    )
    return stored.unionByName(again)


def archived_pages(
    df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None, chunk: int = CHUNK, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """Write every row of ``df`` as a WARC record under ``path`` and give what the archives hold.

    One row per row of ``df``, with the columns of ``resolved`` and ``key`` and ``refers_to`` in the
    key's own type. Null and empty payloads are records of 0 bytes; null keys and urls stay null and
    missing; repeated rows are records of their own, all but one revisits if their payload has
    ``least_bytes``; other columns of ``df``, whatever their names, play no part. A payload of any length is moved chunk by chunk. An empty
    table gives an empty archive and no rows.
    """
    spark = df.sparkSession
    path = path or run_folder(spark, "warc")
    chunks = written(chunk_rows(df, key, url, payload, chunk), "warc-chunks", "zstd")
    write_archives(chunks, decide(chunks, least_bytes), path)
    kind = df.select(col(key)).schema[0].dataType
    own = lambda c: F.url_decode(c).cast(kind).alias(c)
    return resolved(read_records(spark, path, chunk)).select(own("key"), "payload_bytes", "payload_digest", "record_type", own("refers_to"), "intact")
