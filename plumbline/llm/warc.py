"""WARC archives: a gzip member for each record, written and read back in sequence."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: WARC 1.1's name for a revisit whose payload is that of an earlier record (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of every record, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, place: str) -> str:
    """The URN of a page's record; a page without an id is named by its place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'place:{place}')}>"


def _line(value: str | None) -> str:
    """A header value on one line; what would end the line is percent-encoded."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, place: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, place)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{base32_sha1(body)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '')}", f"X-Refers-To-Page: {refers_to}"]), f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    body: bytes

    @property
    def payload_digest(self) -> str:
        return self.headers["warc-payload-digest"].removeprefix("sha1:")


def _headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode().split("\r\n")[1:] if x)}


def members(stream, piece: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream in turn, decompressed piece by piece as they are read."""
    waiting = b""
    while True:
        waiting = waiting or stream.read(piece)
        if not waiting:
            return
        press, out = zlib.decompressobj(31), []
        while not press.eof:
            if not waiting:
                waiting = stream.read(piece)
                if not waiting:
                    raise ValueError("an archive ends within a record")
            out.append(press.decompress(waiting))
            waiting = press.unused_data if press.eof else b""
        yield b"".join(out)


def read_records(stream) -> Iterator[Record]:
    """Records of an archive in sequence. Lengths and digests are checked; what fails is an error."""
    for data in members(stream):
        head, mark, rest = data.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _headers(head)
        n = int(headers["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("a record's block does not have its digest")
        http, _, body = block.partition(b"\r\n\r\n")
        found = Record(headers, _headers(http), body)
        if headers["warc-type"] == "response":
            if int(found.http["content-length"]) != len(body) or found.payload_digest != base32_sha1(body):
                raise ValueError("a response's payload does not have its length or digest")
        yield found


OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string())])
OUT_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """An archive for each partition of pages (page_id, url, html, refers_to); lazy. Rows: path, n."""

    def task(batches):
        path, n, out = f"{folder}/{common.attempt_name()}.warc.gz", 0, None
        fs, p = common.filesystem(path)
        for batch in batches:
            out = out or fs.open_output_stream(p)
            for page_id, url, body, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                out.write(record(page_id, url, body, refers, f"{path}#{n}"))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    return pages.mapInArrow(task, "path string, n long")


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each record of the archives (OUT)."""

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=OUT)

    def task(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = common.filesystem(path)
                found: list[dict] = []
                with fs.open_input_stream(p) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        found.append({"page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "payload_bytes": int(r.http["content-length"]), "payload_digest": r.payload_digest, "record_type": h["warc-type"], "refers_to": int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, "url": h["warc-target-uri"], "archive": path.rpartition("/")[2]})
                        if len(found) == 2048:
                            yield rows(found)
                            found = []
                if found:
                    yield rows(found)

    return common.spread(spark.createDataFrame([(p,) for p in paths], "path string"), len(paths), "path").mapInArrow(task, OUT_DDL)


def archive(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to WARC archives and read them back, a row for each page.

    Of pages with equal payloads of at least `least` bytes the one with the
    smallest page_id is a response, the others are revisits of it; smaller
    payloads are all responses. Payloads are equal if their SHA-256 is.

    Only digests are grouped and joined; a page's html moves once, to the join
    with its decision by page_id, which no group of copies skews. A null html is
    empty, a null url too; a payload of any length is one record. A null page_id
    is never referred to, and is a response. Rows that repeat a page_id with
    equal payload are one response each. An empty table gives no rows; other
    columns are ignored. A revisit whose response is not there with the same
    digest is an error.
    """
    scratch = common.Scratch(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = scratch.keep(pages.filter(F.octet_length("html") >= least).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")), "digests")
    firsts = scratch.keep(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "firsts")
    again = scratch.keep(digests.join(firsts, "digest").filter("page_id <> first").select(F.col("page_id").alias("of"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct(), "again")
    on = (F.col("page_id") == F.col("of")) & (F.sha2(F.col("html").cast("binary"), 256) == F.col("same"))
    told = pages.join(again, on, "left").select("page_id", "url", "html", "refers_to")
    paths = [r.path for r in write_archives(told, scratch.folder("archives")).collect()]  # a row for each partition
    rows = scratch.keep(read_archives(spark, paths), "rows")
    lost = unanswered(rows).first()
    if lost is not None:
        raise ValueError(f"page {lost.page_id}: no response of page {lost.refers_to} has its digest")
    return rows


def unanswered(rows: DataFrame) -> DataFrame:
    """Revisits (of OUT's rows) that refer to a page without a response of their payload's digest."""
    responses = rows.filter("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("same"))
    return rows.filter("record_type = 'revisit'").join(responses, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left_anti")


#: Rows-for-rows SQL of the query over pages. Base32 takes 5 bits of the SHA-1 at a time, from 20 bits in 5 hexadecimal digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
