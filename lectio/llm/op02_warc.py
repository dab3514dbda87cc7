"""WARC: archives written from a table of pages, and captures assembled from the archives.

Writing: a page becomes a request, a response (or revisit) and a metadata record. The request
and the metadata name the response in ``WARC-Concurrent-To``; a revisit names the response with
the same payload in ``WARC-Refers-To``. Records are packed into archives of bounded size inside
tasks, and Spark's text writer stores one archive a file (record separators are its line ends),
so any file system that Spark writes to will do.

Reading: archives are parsed by ``Content-Length``, not by separators, so payloads may hold
anything. Records of one transaction meet by one grouping on the id they share through
``WARC-Concurrent-To``; the result is one nested row per capture.

Defined cases: null html: empty payload; null url: no target URI; null page id: a capture
without page id, after all others in order; rows equal in page id, url and html are one
capture; rows with one page id but other contents are captures of their own; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lectio.session import scratch_path

ARCHIVE_BYTES = 16 << 20
REVISIT_FROM_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(digest: str) -> str:
    return f"<urn:uuid:{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:32]}>"


def _record(kind: str, record_id: str, content_type: str, block: bytes, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def transaction(page_id, url, payload: bytes, digest: str, capture: str, first_page, first_capture: str | None) -> list[bytes]:
    """The records of one page; ``first_capture`` is given for a revisit."""
    own = _urn(capture)
    uri = None if url is None else quote(url, safe=";/?:@&=+$,-_.!~*'()#%[]")
    parts = urlsplit(uri or "")
    request = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first_capture is None:
        main = _record("response", own, "application/http;msgtype=response", http + payload, WARC_Target_URI=uri, WARC_Payload_Digest=f"sha256:{digest}")
    else:
        main = _record("revisit", own, "application/http;msgtype=response", http, WARC_Target_URI=uri, WARC_Payload_Digest=f"sha256:{digest}", WARC_Profile=PROFILE, WARC_Refers_To=_urn(first_capture))
    fields = [("pageId", page_id), ("refersToPageId", first_page if first_capture else None)]
    note = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    derived = [_urn(hashlib.md5(f"{kind} {capture}".encode()).hexdigest()) for kind in ("request", "metadata")]
    return [
        _record("request", derived[0], "application/http;msgtype=request", request, WARC_Target_URI=uri, WARC_Concurrent_To=own),
        main,
        _record("metadata", derived[1], "application/warc-fields", note, WARC_Target_URI=uri, WARC_Concurrent_To=own),
    ]


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC 1.1 archives of about ``archive_bytes``
    (a longer page alone) under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = rows.withColumn("digest", digest)
    rows = rows.withColumn("capture", F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.when(F.col("url").isNull(), "-").otherwise(F.sha2("url", 256)), "digest").cast("binary")))
    # Only digests that occur more than once join; the partial counts are combined before the shuffle.
    firsts = (
        rows.filter(F.octet_length("html") >= REVISIT_FROM_BYTES)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "capture")).alias("first"))
        .filter("n > 1")
        .select("digest", F.col("first.page_id").alias("first_page"), F.col("first.capture").alias("first_capture"))
    )
    rows = rows.join(firsts, "digest", "left")
    # Pages that tie for the smallest id are all responses.
    again = F.col("first_capture").isNotNull() & (F.col("first_capture") != F.col("capture")) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = rows.withColumn("first_capture", F.when(again, F.col("first_capture")))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "capture", "first_page", "first_capture"))):
                records = transaction(row[0], row[1], row[2].encode(), *row[3:])
                held += records
                size += sum(map(len, records))
                if size >= archive_bytes:
                    yield pa.record_batch([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])

    archives = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at: at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        head = data[at: end].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4: end + 4 + size]
        at = end + 4 + size


RECORDS = "capture string, record_type string, record_id string, target_uri string, refers_to_record string, payload_digest string, payload_bytes long, payload binary, request string, page_id long, refers_to long, sound boolean"


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; ``capture`` is the id of the response
    or revisit that the record belongs to (its own, or the one that it is concurrent to)."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                out: list[tuple] = []
                size = 0
                for headers, block in parse_archive(zlib.decompress(content.as_py(), 31)):
                    row = dict.fromkeys(names)
                    kind = headers["warc-type"]
                    row |= {"record_type": kind, "record_id": headers["warc-record-id"], "target_uri": headers.get("warc-target-uri"), "refers_to_record": headers.get("warc-refers-to")}
                    row["capture"] = headers.get("warc-concurrent-to", row["record_id"])
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                        row["payload_bytes"] = int(http["content-length"])
                        row["payload_digest"] = headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            row["payload"] = body if payload else None
                            row["sound"] = len(body) == row["payload_bytes"] and hashlib.sha256(body).hexdigest() == row["payload_digest"]
                    elif kind == "request":
                        row["request"] = block.split(b"\r\n", 1)[0].decode("utf-8", "replace")
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                        row["page_id"] = int(fields["pageId"]) if "pageId" in fields else None
                        row["refers_to"] = int(fields["refersToPageId"]) if "refersToPageId" in fields else None
                    out.append(tuple(row.values()))
                    size += len(block)
                    if size >= 1 << 21 or len(out) >= 4096:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        made = [x.split() for x in RECORDS.split(", ")]
        return pa.record_batch([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*out), made)], [n for n, _ in made])

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    except AnalysisException as error:  # no archive: the table of pages was empty
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RECORDS)
    return files.mapInArrow(parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its request and its metadata, joined
    through the concurrent-to ids. Repeats of a record collapse; parts that are absent are null."""
    def part(test, *columns: str):
        return F.max(F.when(test, F.struct(*columns)))

    main = F.col("record_type").isin("response", "revisit")
    return (
        records.groupBy("capture")
        .agg(
            part(main, "record_type", "record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to_record", "sound", "payload").alias("response"),
            part(F.col("record_type") == "request", "record_id", "target_uri", "request").alias("request"),
            part(F.col("record_type") == "metadata", "record_id", "page_id", "refers_to").alias("metadata"),
        )
        .filter("response is not null")
    )


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: archives written from ``pages``, read back and assembled."""
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(read_records(spark, path, payload=False))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )


ORACLE = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload, sha256(encode(coalesce(html, ''))) as payload_digest from pages),
f as (
  select *, octet_length(payload) as payload_bytes, min(page_id) over (partition by payload_digest) as first_page from p)
select distinct page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_page then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to
from f
"""
