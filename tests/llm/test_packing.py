import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import common, packing
from plumbline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("weights", [None, [5, 2, 1], [1, 0, 3], [0, 0, 0]])
def test_plan_serves_all_in_proportion(weights):
    totals = [9000, 2500, 40_000]
    phases = packing.plan(totals, weights, 640)
    assert [sum(p.quota[q] for p in phases) for q in range(3)] == totals
    assert sum(map(sum, (p.quota for p in phases))) == sum(totals)
    for p in phases:
        for w in range(p.windows):
            parts = np.diff(p.starts(w))
            assert (parts >= 0).all() and sum(parts) <= 640 + 3
            # deficits carry: what was served so far is the exact share, less a part of one token
            for q, quota in enumerate(p.quota):
                assert 0 <= quota * (w + 1) / p.windows - p.served(q, w + 1) < 1
            assert p.starts(w)[-1] == p.starts(w + 1)[0]
    if weights == [5, 2, 1]:
        first = phases[0]
        assert abs(first.quota[0] / sum(first.quota) - 5 / 8) < 1e-3


def test_pieces_cover_each_token_once():
    totals = [701, 33, 2050]
    phases = packing.plan(totals, None, 256)
    seen = np.zeros(sum(totals), int)
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(97, total - at)
            pieces = packing.pieces_of(phases, q, at, n, 64, {})
            assert sum(p[2] for p in pieces) == n
            for s, o, m in pieces:
                assert o + m <= 64
                seen[s * 64 + o : s * 64 + o + m] += 1
            at += n
    assert (seen == 1).all()


def check(pieces, rows, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = sorted((r[0] is not None, r[0] or 0, len(ids := t.encode(r[1] or "", add_special_tokens=False).ids + [1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.doc_id].append(p)
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for o, n in sorted(by_sequence[s]):
            assert o == at
            at += n
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence))) and all(n == length for n in sizes[:-1]) and sizes[-1] <= length
    assert sum(sizes) == sum(w[2] for w in want)
    once = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for has, doc, n, crc in want:
        if has and doc in once:
            own = sorted(by_doc[doc], key=lambda p: p.start)
            assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
            assert zlib.crc32(b"".join(p.ids for p in own)) == crc and all(p.doc_tokens == n for p in own)


def test_pack_against_plain_encoding(spark, docs, rows):
    pieces = packing.pack(spark, docs, PATH, length=128, window_sequences=4, with_ids=True)
    found = pieces.collect()
    check(found, rows, 128)
    # every window but the last holds each source in its share of the corpus
    totals, windows = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in found:
        totals[p.label] += p.length
        windows[p.sequence_id // 4][p.label] += p.length
    total = sum(totals.values())
    for w in sorted(windows)[:-1]:
        for s, n in totals.items():
            assert abs(windows[w][s] - 512 * n / total) <= 2 * len(totals) + 2
    packed = packing.sequences(pieces, 128).collect()
    assert all(len(r.ids) == 4 * 128 for r in packed if r.n_tokens & (r.n_tokens - 1))
    whole = {p.sequence_id: b"" for p in found}
    for p in sorted(found, key=lambda p: (p.sequence_id, p.offset)):
        whole[p.sequence_id] += p.ids
    assert all(bytes(r.ids)[: 4 * r.n_tokens] == whole[r.sequence_id] for r in packed)


def test_weights_and_many_sources(spark, docs, rows, monkeypatch):
    check(packing.pack(spark, docs, PATH, length=128, window_sequences=2, weights={"a": 3, "c": 1}, with_ids=True).collect(), rows, 128)
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    check(packing.pack(spark, docs, PATH, length=128, with_ids=True).collect(), rows, 128)


def test_more_sources_than_512(spark):
    """Every source is a queue of its own: named in the label, and in its share at the end of each window."""
    rows = [(k, f"a document {k} of one source among many of them " * (1 + k % 3), f"site{k % 600}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs = common.Scratch(spark, "t").keep(docs, "docs")  # the same rows in the same files for both calls
    found = packing.pack(spark, docs, PATH, length=128, window_sequences=16, with_ids=True).collect()
    check(found, rows, 128)
    assert {(p.doc_id, p.label) for p in found} == {(r[0], r[2]) for r in rows}
    totals = defaultdict(int)
    for p in found:
        totals[p.label] += p.length
    names = sorted(totals)
    (phase,) = packing.plan([totals[s] for s in names], None, 128 * 16)
    assert phase.windows > 5
    for w in range(phase.windows):
        end, served = int(phase.starts(w)[-1]), defaultdict(int)
        for p in found:
            served[p.label] += max(0, min(p.length, end - (p.sequence_id * 128 + p.offset)))
        assert [served[s] for s in names] == [totals[s] * (w + 1) // phase.windows for s in names]


def test_empty(spark, no_docs):
    assert packing.pack(spark, no_docs, PATH).collect() == []
