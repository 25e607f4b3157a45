"""WARC archives as chunked record tables.

Writing turns each payload into rows of record identifier and chunk number, cut by Spark from the payload's bytes. A
row is a WARC record by itself: the first chunk is a ``response``, further ones are ``continuation`` records with
segment numbers, each with the digest of the payload so far, which is carried along while the chunks of a record
stream past. Spark's text writer commits the records; its line separator is the blank line that ends a record.
Payloads that were written before are ``revisit`` records without a body.

Reading is Spark's text reader with the same separator: what stands between blank lines comes as rows, in order, and
a parser puts records together from them, one chunk at a time. Digests of records of several chunks are taken in
chunk order over a stream of rows; no task holds a whole payload or archive. (In the table of pages a payload is one
value, so Spark's row has it once.)

Files are gzip, one stream for each file: Spark doesn't split them, so rows come from the first record on.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.store import cut

CHUNK = 1 << 16
RECORDS_PER_FILE = 4096
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
#: Elements of an array that numbers the copies of a page; more copies take several arrays.
_RUN = 1 << 16

CHUNKS = "record_id string, chunk_no int, record_type string, page_id long, refers_to long, payload_digest string, payload_bytes long, running_digest string, last boolean, chunk binary"
_CHUNKS = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("running_digest", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary())])


def base32_of_hex(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit digest in hex: four groups of 40 bits, eight symbols each."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: int | None, sha: str, copy: int) -> str:
    """Rows that share a page id, or have none, differ in payload or copy number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}:{copy}')}>"


def _record(headers: list[tuple[str, object]], body: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body


def _clean(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def chunk_record(page_id: int | None, sha: str, copy: int, url: str | None, number: int, chunks: int, total: int, so_far: str, piece: bytes) -> bytes:
    """The WARC record of one chunk (of ``chunks``, numbered from 1); ``so_far`` is the digest of the payload up to its end, ``total`` its length."""
    rid, last = _record_id(page_id, sha, copy), number == chunks
    headers = [
        ("WARC-Type", "response" if number == 1 else "continuation"),
        ("WARC-Record-ID", rid if number == 1 else rid.replace(">", f":{number}>")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("Content-Type", "application/http;msgtype=response" if number == 1 else None),
        ("WARC-Segment-Number", number if chunks > 1 else None),
        ("WARC-Segment-Origin-ID", rid if number > 1 else None),
        ("WARC-Segment-Total-Length", total + len(_HTTP) if last and chunks > 1 else None),
        ("WARC-Payload-Digest", f"sha1:{so_far}" if last else None),
        ("X-Running-Digest", f"sha1:{so_far}"),
        ("X-Page-ID", page_id),
    ]
    return _record(headers, (_HTTP if number == 1 else b"") + piece)


def revisit_record(page_id: int | None, sha: str, copy: int, url: str | None, digest: str, length: int, refers_to: int | None) -> bytes:
    headers = [
        ("WARC-Type", "revisit"),
        ("WARC-Record-ID", _record_id(page_id, sha, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", _record_id(refers_to, sha, 0)),
        ("X-Payload-Length", length),
        ("X-Refers-To-Page", refers_to),
        ("X-Page-ID", page_id),
    ]
    return _record(headers, b"")


def _numbered(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0, without an array of that length."""
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / _RUN))))
    inside = F.sequence(F.col("_run") * _RUN, F.least(count, (F.col("_run") + 1) * _RUN) - 1)
    return runs.withColumn(name, F.explode(inside)).drop("_run")


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0, chunk: int = CHUNK) -> None:
    """Write a WARC record for each row of ``pages(page_id, url, html)`` under ``path``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, that with the smallest ``page_id`` (null after all
    others) is a response and the others revisit it; smaller payloads are all responses. A null payload is empty.
    Rows that repeat page and payload are records of their own; the first of them is the response. Rows that share a
    page id have records of their own. An empty table gives an empty folder; other columns are ignored. A payload of any
    length is cut into chunks in Spark's row of it; Python and the archives hold one chunk at a time.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    # narrow: one row for each page and payload
    each = cut(keyed.groupBy("sha", "bytes", "page_id").agg(F.count("*").alias("copies"), F.min("url").alias("url")), "digests")
    first = each.groupBy("sha", "bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).getField("page_id").alias("original"))
    each = cut(each.join(cut(first, "originals"), ["sha", "bytes"]), "planned")
    small = F.col("bytes") < min_revisit
    is_first = F.col("page_id").eqNullSafe(F.col("original"))
    # copy 0 of a page that is first is a response, and so are all copies of a small payload
    revisits = _numbered(each.where(~small), F.col("copies"), "copy").where(~(is_first & (F.col("copy") == 0)))
    responses = each.where(small | is_first).select("sha", "page_id", F.when(small, F.col("copies")).otherwise(1).alias("wanted"))
    full = keyed.withColumn("p", F.coalesce("page_id", F.lit(-1))).join(responses.withColumn("p", F.coalesce("page_id", F.lit(-1))).withColumnRenamed("page_id", "p2"), ["sha", "p"])
    full = full.where(F.col("page_id").eqNullSafe(F.col("p2"))).select("sha", "page_id", "url", "bytes", "payload", "wanted")
    if not each.where("copies > 1").isEmpty():
        full = full.groupBy("sha", "page_id").agg(F.min("url").alias("url"), F.first("bytes").alias("bytes"), F.min("payload").alias("payload"), F.first("wanted").alias("wanted"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk)).cast("int")
    # the chunks of a record stay together and in order, as nothing moves rows between here and the writer
    parts = _numbered(full, F.col("wanted"), "copy").withColumn("chunks", chunks).withColumn("number", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    parts = parts.select("page_id", "sha", "copy", "url", "number", "chunks", F.substring("payload", (F.col("number") - 1) * chunk + 1, F.lit(chunk)).alias("piece"))

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, total = hashlib.sha1(), 0
        for batch in batches:
            out: list[bytes] = []
            for page_id, sha, copy, url, number, n, piece in zip(*[batch.column(c) for c in ("page_id", "sha", "copy", "url", "number", "chunks", "piece")], strict=True):
                if number.as_py() == 1:
                    so_far, total = hashlib.sha1(), 0
                raw = piece.as_py()
                so_far.update(raw)
                total += len(raw)
                out.append(chunk_record(page_id.as_py(), sha.as_py(), copy.as_py(), url.as_py(), number.as_py(), n.as_py(), total, _base32(so_far.digest()), raw))
                if len(out) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    def revisit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "sha", "copy", "url", "digest", "bytes", "original")]
            yield pa.RecordBatch.from_arrays([pa.array([revisit_record(*r) for r in zip(*cols, strict=True)], pa.binary())], ["value"])

    records = parts.mapInArrow(respond, "value binary")
    again = revisits.select("page_id", "sha", "copy", "url", base32_of_hex(F.col("sha")).alias("digest"), "bytes", "original").mapInArrow(revisit, "value binary")
    # the text writer writes a string's bytes as they are
    lines = records.unionByName(again).select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", _END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


class RecordParser:
    """Takes the bytes of archives piece by piece, each up to a blank line, and gives a chunk row for each record that is complete."""

    def __init__(self) -> None:
        self.headers: dict[str, str] | None = None
        self.body = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple]:
        while data:
            if self.headers is None:
                data = data.lstrip(b"\r\n")
                if not data:
                    return
                if not data.startswith(b"WARC/1."):
                    raise ValueError(f"no WARC record begins with {data[:40]!r}")
                head, _, data = data.partition(_END)
                self.headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            else:
                self.body += data
                data = b""
            length = int(self.headers["Content-Length"])
            if length and len(self.body) < length + len(_END):
                continue
            body, rest = bytes(self.body[:length]), bytes(self.body[length:])
            if length and not rest.startswith(_END):
                raise ValueError(f"record {self.headers['WARC-Record-ID']} is longer than it says")
            yield self._row(self.headers, body)
            self.headers, self.body = None, bytearray()
            data = rest[len(_END) :] + data

    def close(self) -> None:
        if self.headers is not None:
            raise ValueError(f"record {self.headers['WARC-Record-ID']} is cut off")

    @staticmethod
    def _row(h: dict[str, str], body: bytes) -> tuple:
        digest = h.get("WARC-Payload-Digest", "sha1:")[5:] or None
        page, refers = (int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page"))
        if h["WARC-Type"] == "revisit":
            return h["WARC-Record-ID"], 1, "revisit", page, refers, digest, int(h["X-Payload-Length"]), digest, True, None
        if h["WARC-Type"] == "response":
            body = body[body.index(_END) + len(_END) :]
        origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
        return origin, int(h.get("WARC-Segment-Number", 1)), "response", page, None, digest, len(body), h["X-Running-Digest"][5:], digest is not None, body


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunk rows of all archives under ``path``. Without ``payloads``, a record of one chunk comes with its digest checked and without its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = RecordParser()
        for batch in batches:
            out: list[tuple] = []
            for line in batch.column("value"):
                for row in parser.feed(line.as_py() + _END):
                    body = row[-1]
                    if body is not None:
                        single = row[1] == 1 and row[8]
                        if single and _base32(hashlib.sha1(body).digest()) != row[5]:
                            raise ValueError(f"record {row[0]} doesn't have its digest")
                        row = (*row[:-1], body if payloads or not single else None)
                    out.append(row)
                    if len(out) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)
        parser.close()

    lines = spark.read.option("lineSep", _END.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)


def digest_records(chunks: DataFrame) -> DataFrame:
    """Chunk rows -> a row for each record of several chunks, with its length and digest taken chunk by chunk.

    Chunks come in order of record and number; the running digest that each carries is checked, so a missing,
    doubled or misplaced chunk fails the job.
    """
    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, sha, total, number = None, hashlib.sha1(), 0, 0
        for batch in batches:
            out = []
            for rid, no, page, running, last, body in zip(*[batch.column(c) for c in ("record_id", "chunk_no", "page_id", "running_digest", "last", "chunk")], strict=True):
                if rid.as_py() != record:
                    record, sha, total, number = rid.as_py(), hashlib.sha1(), 0, 0
                raw = body.as_buffer()
                sha.update(raw)
                total, number = total + len(raw), number + 1
                if no.as_py() != number or running.as_py() != _base32(sha.digest()):
                    raise ValueError(f"chunk {no} of record {record} doesn't follow")
                if last.as_py():
                    out.append((page.as_py(), total, running.as_py()))
            pages, lengths, digests = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], ["page_id", "payload_bytes", "payload_digest"])

    return ordered.select("record_id", "chunk_no", "page_id", "running_digest", "last", "chunk").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record under ``path``.

    Null page ids come back as null, repeated records as many times as they were written; payloads of several chunks are
    digested chunk by chunk. A folder of an empty table gives no rows.
    """
    chunks = cut(read_chunks(spark, path, payloads=False), "chunks")
    whole = "record_type = 'revisit' or (chunk_no = 1 and last)"
    done = chunks.where(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    parts = digest_records(chunks.where(f"not ({whole})"))
    return done.unionByName(parts.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))
