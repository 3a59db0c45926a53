import random
import re
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import common, mixing, sharding


def test_shards(spark, docs, rows):
    got = sharding.shard(spark, docs, 4).collect()
    sizes = defaultdict(list)
    for r in rows:
        text = (r[1] or "").encode()
        sizes[r[0]].append((len(text) + 1, zlib.crc32(text)))
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(str((d, *x)) for d, xs in sizes.items() for x in xs)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    order = []
    for s in sorted(by):
        own = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) <= largest
        order += own
    assert [key(r) for r in order] == sorted(map(key, got))


def test_shards_of_nothing(spark, no_docs):
    assert sharding.shard(spark, no_docs).collect() == []


def brute_fill(sizes, weights, total, epochs):
    caps = [epochs * s for s in sizes]
    fixed = set()
    while True:
        free = [q for q in range(len(sizes)) if q not in fixed]
        if not free:
            return caps
        rest = total - sum(caps[q] for q in fixed)
        part = {q: rest * weights[q] / sum(weights[r] for r in free) for q in free}
        over = [q for q in free if part[q] > caps[q]]
        if not over:
            return [caps[q] if q in fixed else part[q] for q in range(len(sizes))]
        fixed.update(over)


@pytest.mark.parametrize("seed", range(6))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 5, 40])
    sizes = [rng.choice([0, 3, rng.randint(0, 1000)]) for _ in range(n)]
    names = sorted({f"s{k}" for k in range(n)} - {"s0"}) + [None]
    frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long").repartition(3)
    cycle = [5.0, 2.0, 1.0]
    got = {r.source: r for r in mixing.targets(common.Scratch(spark, "fill"), frame, cycle, 1.5, 2.0).collect()}
    want = brute_fill(sizes, [cycle[k % 3] for k in range(n)], 1.5 * sum(sizes), 2.0)
    assert [got[s].target for s in names] == pytest.approx(want) and [got[s]["size"] for s in names] == sizes
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * sum(sizes)) and all(r.target <= 2 * r["size"] + 1e-9 for r in got.values())


def test_sources_without_weight(spark):
    rows = [("a", 10, 1.0, 0, 1), ("b", 10, 0.0, 1, 1), ("c", 10, 3.0, 2, 1)]
    frame = spark.createDataFrame(rows, "source string, size long, weight double, no long, one long")
    got = {r.source: r.target for r in mixing.water_fill(common.Scratch(spark, "fill"), frame, 20.0, 2.0).collect()}
    assert got == {"a": 5.0, "b": 0.0, "c": 15.0}


def test_mix(spark, docs, rows):
    got = mixing.mix(spark, docs)
    assert [c for c in docs.columns if c not in got.columns] == []
    found = got.collect()
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += size(r[1])
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute_fill([totals[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(totals.values()), 2.0), strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert (r["size"], r.source_size) == (size(r.text), totals[r.source]) and r.target == pytest.approx(target[r.source])
        assert r.taken == r["size"] * r.times <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = mixing.mix(spark, docs.repartition(3)).collect()
    key = lambda r: str((r.doc_id, r.text, r.taken))
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_mix_of_nothing(spark, no_docs):
    assert mixing.mix(spark, no_docs).collect() == []


def test_one_source_of_empty_texts(spark):
    frame = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(spark, frame).collect()] == [0, 0]
