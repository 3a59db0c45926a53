import base64
import hashlib
import io
from collections import defaultdict

import pytest

from plumbline.llm import warc

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>y</p>"), (3, "u\r\nv", "<p>x</p>"), (0, None, "<p>x</p>"), (4, "", None), (5, "e", ""), (6, "é", "ü" * 70_000), (7, "é", "ü" * 70_000), (8, "n", "a\r\n\r\nb\r\n\r\n"), (None, "z", "<p>x</p>"), (9, "d", "same"), (9, "d", "same")]


def test_archive(spark):
    pages = spark.createDataFrame([(*p, "x", "x", 5) for p in PAGES], "page_id long, url string, html string, digest string, first string, refers_to int").repartition(4)
    got = warc.archive(spark, pages).collect()
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = min(x for x in groups[h or ""] if x is not None)
        revisit = i is not None and i != first
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_least_bytes(spark):
    pages = spark.createDataFrame(PAGES[:8], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive(spark, pages, least=100).collect()}
    assert [i for i in got if got[i] == "revisit"] == [7]


def test_empty(spark):
    assert warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_reader_checks():
    one, two = warc.record(1, "u", b"body" * 5000, None, "p"), warc.record(2, "u", b"", 1, "p")
    found = list(warc.read_records(io.BytesIO(one + two)))
    assert [r.headers["warc-type"] for r in found] == ["response", "revisit"] and found[0].body == b"body" * 5000
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(one[:-20])))
    import zlib

    plain = zlib.decompress(one, 31).replace(b"bodybody", b"bodyBODY", 1)
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(press.compress(plain) + press.flush())))
    assert [len(m) > 0 for m in warc.members(io.BytesIO(one + two), piece=7)] == [True, True]


def test_revisits_without_their_response(spark):
    rows = [(1, 0, "A", "response", None), (2, 0, "A", "revisit", 1), (3, 0, "B", "revisit", 1), (4, 0, "A", "revisit", 9)]
    frame = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    assert sorted(r.page_id for r in warc.unanswered(frame).collect()) == [3, 4]
