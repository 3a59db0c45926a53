import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import common, exact_dedup, near_dedup

UPPER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@given(st.sets(st.integers(0, 2**40), max_size=60), st.integers(0, 40))
def test_golomb_round_trip(values, r):
    if values and max(values) >> r > 1 << 20:
        r = 30
    v = np.array(sorted(values), np.uint64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, r), len(v), r) == v).all()


def test_golomb_is_small():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 10_000).astype(np.uint64))
    data = exact_dedup.golomb_encode(v, exact_dedup.rice_parameter(1 << 32, len(v)))
    assert 8 * len(data) / len(v) < 32 - np.log2(len(v)) + 3


@pytest.mark.parametrize("spare", [None, -6])
def test_exact(spark, docs, rows, monkeypatch, spare):
    if spare is not None:  # fingerprints so short that most collide: only the comparison of bytes tells texts apart
        monkeypatch.setattr(exact_dedup, "SPARE", spare)
    got = exact_dedup.exact_dedup(spark, docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UPPER)].append(r[0])
    want = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id == r.keep_id)
    assert len(kept) == len(groups) and all(k == [True] for k in kept.values())
    assert len({r.row for r in got}) == len(rows)


def test_exact_empty(spark, no_docs):
    assert exact_dedup.exact_dedup(spark, no_docs).collect() == []


def brute_sets(rows):
    out = []
    for _, text, *_ in rows:
        w = (text or "").translate(UPPER).encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_classes(rows):
    """A number for each row, equal where links lead from one to the other."""
    sets = brute_sets(rows)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def brute_components(rows):
    least = defaultdict(list)
    classes, sets = brute_classes(rows), brute_sets(rows)
    for c, r in zip(classes, rows, strict=True):
        if r[0] is not None:
            least[c].append(r[0])
    return [(r[0], len(s), min(least[c], default=None)) for c, r, s in zip(classes, rows, sets, strict=True)]


@pytest.mark.parametrize("block, chunk", [(near_dedup.BLOCK, near_dedup.CHUNK), (4, 500)])
def test_near(spark, docs, rows, block, chunk):
    got = near_dedup.near_dedup(spark, docs, block, chunk=chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 4])
def test_near_longer_texts(spark, block):
    """Sketches shorter than the sets, similarities around the threshold, a passage that all texts share."""
    from tests.llm.conftest import words

    import random

    rng = random.Random(11)
    passage = words(rng, 60)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randint(150, 500)).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 30)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((len(rows), " ".join(copy) + " " + passage, "en", "a"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = near_dedup.near_dedup(spark, common.Scratch(spark, "t").keep(frame, "docs"), block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_near_long_chain(spark):
    """600 texts, each similar to its next and to no other: rolling windows over one long text."""
    from tests.llm.conftest import words

    import random

    text = words(random.Random(23), 4 * 600 + 36).split()
    rows = [(k, " ".join(text[4 * k : 4 * k + 40])) for k in range(600)]
    sets = brute_sets(rows)
    similar = [[100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets, sets[n:])] for n in (1, 2)]
    assert all(similar[0]) and not any(similar[1])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(spark, common.Scratch(spark, "t").keep(frame, "docs")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(k, 0, k == 0) for k in range(600)]


def test_near_empty(spark, no_docs):
    assert near_dedup.near_dedup(spark, no_docs).collect() == []


def binomial(k, p, x):
    """Chance that a binomial count of k draws is below x."""
    return sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(x))


def hypergeometric(union, marked, k, x):
    return sum(Fraction(math.comb(marked, i) * math.comb(union - marked, k - i), math.comb(union, k)) for i in range(x) if k - i <= union - marked)


def test_needed():
    assert near_dedup.needed(1) == 1 and near_dedup.needed(96) == 72 and near_dedup.needed(384) == 288
    for k in (64, near_dedup.ESTIMATE, near_dedup.K):
        x = near_dedup.lower_end(k, None)
        assert binomial(k, 0.75, x) <= near_dedup.MISS < binomial(k, 0.75, x + 1)
    for size in (60, 100, 150, 333, 1000, 3000, 100_000):
        assert 1 <= near_dedup.needed(size, 64) <= min(64, size)
        for union in {size, size + 1, (size + size * 4 // 3) // 2, size * 4 // 3}:
            if 64 < union < 5000:  # every union that the set can have with a similar one
                assert hypergeometric(union, -(-3 * union // 4), 64, near_dedup.needed(size, 64)) <= near_dedup.MISS


def test_estimates_follow_similarity():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = np.sort(rng.choice(pool, 2000, False)), np.sort(rng.choice(pool, 2000, False))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(near_dedup.estimates([a[:128]], [b[:128]], 128)[0, 0] - true) < 0.2
    small = [np.array([1, 2, 3], np.uint64), np.array([2, 3, 4, 5], np.uint64)]
    assert near_dedup.estimates(small, small)[0, 1] == pytest.approx(2 / 5)


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 700, 5000, 9000)]
    got = near_dedup.overlaps(sets[:3], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


def test_near_passage_without_links(spark):
    """300 texts share a passage of five eighths of their words and nothing else: no links, and few lists of the passage."""
    from tests.llm.conftest import words

    import random

    rng = random.Random(31)
    passage = words(rng, 300)
    rows = [(k, f"{passage} {words(rng, 180)}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scratch = common.Scratch(spark, "t")
    got = near_dedup.near_dedup(spark, scratch.keep(frame, "docs"), chunk=20_000).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(k, k, True) for k in range(300)]
    stars = [s for s in common.Scratch.live if s.root.split("/")[-1].startswith("near-")][-1]
    assert spark.read.parquet(stars.path("stars")).count() == 0


def test_near_classes_and_carried_columns(spark):
    """Rows without an id and rows that repeat one: the class tells which belong together."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour twentyfive"
    rows = [(None, base, "a"), (None, base + " more", "b"), (3, base, "c"), (3, base + " more", "d"), (4, "another text of six words here", "e"), (5, None, "f"), (None, "", "g")]
    got = near_dedup.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, node string"), carry=("node",)).collect()
    by = {r.node: r for r in got}
    assert sorted(by) == list("abcdefg")
    assert len({by[x].class_id for x in "abcd"}) == 1 and by["e"].class_id not in (None, by["a"].class_id)
    assert by["f"].class_id is None and by["g"].class_id is None
    assert [by[x].component_id for x in "abcdefg"] == [3, 3, 3, 3, 4, 5, None]
