"""WARC archives of pages: segmented writing, and reading with segment reassembly.

Writing makes a record for each page: a ``response`` whose block is an HTTP message with a chunked body, or a ``revisit``
where another page has the same payload. A block longer than a segment goes on in ``continuation`` records. The records are
bytes of a text-file sink, so any store that Spark can write takes the archives; a task's files are committed as a whole.

Reading parses each file on its own by the records' lengths. Records in one piece are decoded at once; the segments of
others are grouped by the origin's identifier, ordered by segment number, checked against the total length, joined, and
then decoded: the HTTP head is cut off, the chunked framing undone, and the payload's digest compared with the header.
Revisits are resolved: the response that each refers to has to be in the archives, with the revisit's digest. A missing
segment or response, a wrong length, bad framing or a wrong digest is an error, never a silent loss. A worker holds one file
and, to join it, one whole record.

Nulls and edges: null html is an empty payload; a page without page_id is a response that none refers to; repeated
page_ids that are the largest of their payload are all responses; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_dir, small_batches, table

CRLF = b"\r\n"
#: Payload bytes from which equal payloads become revisits.
REVISIT_BYTES = 1000
#: Bytes of a record's block, of a chunk of the body, and records of a file: a file is at most their product long.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 65536, 8192, 1000
#: Repeated payloads up to which their table is broadcast (under 10 MB); beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, origin string, segment int, total long, data binary"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(framed: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if framed[at:] != CRLF:
                raise ValueError("bytes after the last chunk")
            return b"".join(parts)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        parts.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF  # the sink ends each row with the second CRLF


def records(page_id: str | None, url: str | None, html: bytes, digest: str, refers_to: str | None, number: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The WARC records of one page."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{number}')}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri or "about:blank"),
              ("WARC-Payload-Digest", _label(digest))]
    if page_id is not None:
        common.append(("Page-ID", page_id))
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("Refers-To-Page-ID", refers_to), ("Payload-Length", str(len(html))), http]
        return [_record(more, HTTP_HEAD)]
    block = HTTP_HEAD + chunked(html)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *common, http], block)]
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1"), http], block[:segment])]
    starts = range(segment, len(block), segment)
    for n, at in enumerate(starts, 2):
        part = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{number}/{n}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", part), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if at == starts[-1]:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, block[at : at + segment]))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        at = end + 4 + int(headers["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, data[end + 4 : at]
        at += 4


def inflated(content: bytes) -> bytes:
    """All members of a gzip file; a file that is empty or ends within a member raises."""
    if not content:
        raise ValueError("an archive without a gzip member")
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
        return members.read()


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a whole response block, checked against its digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    body = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if (want := headers.get("warc-payload-digest")) and want != _label(hashlib.sha1(body).hexdigest()):
        raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
    return body


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS, revisit: int = REVISIT_BYTES) -> None:
    """Gzipped archives of ``pages(page_id, url, html)`` in ``path``."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    large = rows.where((F.octet_length("html") >= revisit) & F.col("page_id").isNotNull())
    repeated = cut(large.groupBy(F.col("digest").alias("again")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, F.col("digest") == F.col("again"), "left")
    refers = F.when(F.col("page_id") < F.col("first"), F.col("first")).cast("string")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            for row in batch.itertuples(index=False):
                n += 1
                out += records(row.page_id, row.url, row.html, row.digest, row.refers, f"{task}/{n}", segment)
            yield pd.DataFrame({"record": out})

    made = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", refers.alias("refers")).mapInPandas(build, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", file_records
    ).mode("overwrite").text(path)


def _label(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _hex(label: str | None) -> str | None:
    return base64.b32decode(label[5:]).hex() if label else None


def _resolve(found: DataFrame) -> None:
    """Raise if a revisit refers to no response of its digest. Revisits are counted by what they refer to before any join."""
    wanted = found.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").count()
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    if lost := wanted.join(there, ["refers_to", "payload_digest"], "left_anti").limit(1).collect():
        raise ValueError(f"{lost[0]['count']} revisits refer to page {lost[0]['refers_to']}, whose response with digest {lost[0]['payload_digest']} is not in the archives")


def _found(headers: dict[str, str], body: bytes, keep: bool) -> dict:
    return {"page_id": headers.get("page-id"), "payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(),
            "record_type": "response", "data": body if keep else None}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows ``(page_id, payload_bytes, payload_digest, record_type, refers_to, data)`` of the archives in ``path``."""
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for headers, block in parse(inflated(content)):
                    kind = headers["warc-type"]
                    if kind == "revisit":
                        digest = _hex(headers["warc-payload-digest"])
                        out.append({"page_id": headers.get("page-id"), "payload_bytes": int(headers["payload-length"]), "payload_digest": digest, "record_type": kind, "refers_to": headers["refers-to-page-id"]})
                    elif kind == "continuation" or "warc-segment-number" in headers:
                        out.append({"page_id": headers.get("page-id"), "payload_digest": _hex(headers.get("warc-payload-digest")), "record_type": kind,
                                    "origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "segment": int(headers["warc-segment-number"]),
                                    "total": int(headers.get("warc-segment-total-length", -1)), "data": block})
                    elif kind == "response":
                        out.append(_found(headers, payload(headers, block), with_payload))
                yield pd.DataFrame(out, columns=names, dtype=object)

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("segment")
        block, total = b"".join(parts["data"]), int(parts["total"].max())
        if list(parts["segment"]) != list(range(1, len(parts) + 1)) or len(block) != total:
            raise ValueError(f"record {parts['origin'].iloc[0]}: {len(parts)} segments with {len(block)} of {total} bytes")
        first = parts.iloc[0]
        headers = {"page-id": first["page_id"], "warc-record-id": first["origin"]}
        if first["payload_digest"]:
            headers["warc-payload-digest"] = _label(first["payload_digest"])
        return pd.DataFrame([_found(headers, payload(headers, block), with_payload)], columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    found = cut(files.select("content").mapInPandas(read, _RECORD))
    _resolve(found)
    whole = found.where("origin is null")
    joined = found.where("origin is not null").groupBy("origin").applyInPandas(join, _RECORD)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "data"]
    return whole.unionByName(joined).select(*columns).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).drop("data")


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
m as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < last then last end as refers_to
from m
"""
