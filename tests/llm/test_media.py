import hashlib
import random
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import media


def naive_hash(data, i):
    h = 0
    for b in data[max(0, i - 31) : i + 1]:
        h = (2 * h + int(media.GEAR[b])) % 2**32
    return h


@given(st.binary(min_size=1, max_size=120))
def test_gear_hash(data):
    assert media.gear_hashes(data).tolist() == [naive_hash(data, i) for i in range(len(data))]


@given(st.binary(max_size=4000), st.integers(100, 1500))
def test_cuts_do_not_depend_on_the_piece(data, piece):
    ends = media.cut_points(data, 32, 64, 200, piece)
    assert ends == media.cut_points(data, 32, 64, 200)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == len(data) and all(32 <= n <= 200 for n in sizes[:-1]) and all(0 < n <= 200 for n in sizes[-1:])


def test_cuts_find_shifted_content():
    data = random.Random(2).randbytes(60_000)
    a, b = data, b"some bytes before" + data

    def chunks(d):
        ends = media.cut_points(d)
        return {d[s:e] for s, e in zip([0, *ends], ends)}  # noqa: B905

    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 3


def test_image_round_trip():
    for n in (1, 63, 64, 65, 1000):
        p = media.payload(bytes(range(256))[:n] if n < 256 else b"\n" * n)
        assert len(p) % 64 == 0 and media.samples(media.image(p)) == p
    assert media.payload(b"") == bytes(64)


def test_store(spark, docs, rows):
    got = media.store_media(spark, docs, with_payload=True).collect()
    want = []
    for r in rows:
        text = (r[1] or "").encode()
        p = text + bytes(-len(text) % 64 or (0 if text else 64))
        m = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        want.append((r[0], len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), p))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    features = {}
    for r in got:
        assert features.setdefault(r.payload_sha256, r.feature) == r.feature


def test_chunks_are_stored_once(spark, docs, rows, tmp_path):
    """All places of equal chunks are one place."""
    from plumbline.llm import common

    before = set(common.Scratch.live)
    media.store_media(spark, docs).count()
    scratch = next(s for s in common.Scratch.live if s not in before)
    places = spark.read.parquet(scratch.path("places")).filter("owner >= 0").collect()
    owners = spark.read.parquet(scratch.path("owners"))
    assert len(places) == owners.count() == owners.select("digest").distinct().count() == len({(p.path, p.at, p.off) for p in places})


def test_empty(spark, no_docs):
    assert media.store_media(spark, no_docs).collect() == []
