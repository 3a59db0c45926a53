import zlib

import numpy as np
import pytest

from plumbline.llm import common, language, quality
from plumbline.llm.queries import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.rate(spark, docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [(known[i], r) for i, r in got.items() if r.held_out and i in known]
    right = np.mean([r.predicted == q for q, r in held])
    assert len(held) > 50 and right > 0.9


def test_quality_learns_from_no_held_out_label(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels").toPandas()
    held = labels["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    turned = labels.assign(quality=np.where(held, 1 - labels["quality"], labels["quality"]))
    a, b = ({r.doc_id: r.score for r in quality.rate(spark, docs, spark.createDataFrame(x)).collect()} for x in (labels, turned))
    assert a == b


def test_quality_against_brute_force(spark):
    """Dictionaries, leans and a curve of the test's own make: plain loops over zstandard, steepest descent for the curve."""
    import math
    import random

    import zstandard
    from pyspark.sql import functions as F

    rng = random.Random(6)
    good_words, bad_words = "the river carries small boats past old mills and quiet gardens every morning".split(), "buy now click here win cash free offer zzz qqq 000".split()
    rows, marks = [], []
    for k in range(160):
        q = int(rng.random() < 0.6)
        mixed = [rng.choice(good_words if rng.random() < (0.8 if q else 0.3) else bad_words) for _ in range(rng.randint(3, 400))]
        rows.append((k, " ".join(mixed)))
        marks.append((k, q, 0))
    rows += [(None, "boats past old mills"), (500, ""), (501, None), (502, "x" * 9000)]
    got = {r.doc_id: r for r in quality.rate(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    learned = [(k, q) for k, q, _ in marks if zlib.crc32(str(k).encode()) % 5]
    builds = {r.id: r.b for r in spark.range(160).select("id", (F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(2)) == 0).alias("b")).collect()}
    text = {k: t.encode() for k, t in rows if t is not None}
    pieces = {q: sorted(text[k][a : a + 512] for k, label in learned if label == q and builds[k] for a in range(0, len(text[k]), 512)) for q in (0, 1)}
    presses = []
    for q in (1, 0):
        try:
            data = zstandard.train_dictionary(110 * 1024, pieces[q], k=1000, d=8).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(pieces[q])
        presses.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False))

    def lean(t):
        g, b = (sum(len(p.compress(t[a : a + 512])) for a in range(0, len(t), 512)) for p in presses)
        return (b - g) / (len(t) + 64)

    fitted = sorted((q, lean(text[k])) for k, q in learned if not builds[k])
    prior = sum(q for _, q in learned) / len(learned)
    n1, n0 = sum(q for q, _ in fitted), sum(1 - q for q, _ in fitted)
    weight = [prior * len(fitted) / n1 if q else (1 - prior) * len(fitted) / n0 for q, _ in fitted]
    knots = [float(np.quantile([x for q, x in fitted if not q], p)) for p in (0.75, 0.95)]
    columns = np.array([[x, max(0, x - knots[0]), max(0, x - knots[1])] for _, x in fitted])
    mean, spread = columns.mean(axis=0), columns.std(axis=0)
    z, w = np.column_stack([np.ones(len(fitted)), (columns - mean) / np.where(spread == 0, 1, spread)]), np.zeros(4)
    for _ in range(100_000):
        slope = z.T @ (np.array(weight) * (1 / (1 + np.exp(-z @ w)) - np.array([q for q, _ in fitted]))) + 0.01 * w
        w -= 0.01 * slope
        if np.abs(slope).max() < 1e-7:
            break
    slopes = np.maximum(0, np.cumsum(w[1:] / spread))
    for k, t in rows:
        want = prior
        if t:
            x = lean(t.encode())
            steps = np.diff(slopes, prepend=0)
            want = 1 / (1 + math.exp(-max(-30, min(30, w[0] + steps @ (np.array([x, max(0, x - knots[0]), max(0, x - knots[1])]) - mean)))))
        assert got[k].score == pytest.approx(want, abs=1e-6) and got[k].predicted == int(got[k].score >= 0.3)


def test_quality_edges(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.rate(spark, docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.rate(spark, docs, one).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    both = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.rate(spark, docs, both).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.rate(spark, no_docs, both).collect() == []


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in segmentations(word[n:]):
            yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    rng = np.random.default_rng(0)
    p = np.vstack([rng.random((len(pieces), 2)), np.zeros(2)])
    words = ["a", "ab", "abab", "abba", "bcab", "a"]
    got = language.log_probabilities(language.Table(language.piece_hashes(pieces)), p, 3, words)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            total = 0.0
            for s in segmentations("▁" + w):
                total += np.prod([p[pieces.index(x), k] if x in pieces else language.FLOOR if len(x) == 1 else 0.0 for x in s])
            assert row[k] == pytest.approx(np.log(total))


def test_long_words_are_summed_whole(monkeypatch):
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bab"]
    rng = np.random.default_rng(2)
    p = np.vstack([rng.random((len(pieces), 2)) / 50, np.zeros(2)])
    table = language.Table(language.piece_hashes(pieces))
    monkeypatch.setattr(language, "SLICE", 7)
    for length in (1, 6, 41, 700):
        word = "▁" + "".join(rng.choice(list("abc"), length))
        for k in range(2):
            at = [0.0]
            for j in range(1, len(word) + 1):  # logarithms of sums, place by place
                parts = [at[j - n] + np.log(p[pieces.index(word[j - n : j]), k] if word[j - n : j] in pieces else language.FLOOR) for n in range(1, min(3, j) + 1) if n == 1 or word[j - n : j] in pieces]
                at.append(np.logaddexp.reduce(parts))
            assert language.long_word(table, p, 3, word)[k] == pytest.approx(at[-1])
    counts = {"abab": 3, "bacb": 1, "a": 2, "abcabbab": 5}
    whole = language.fit([counts], pieces)
    monkeypatch.setattr(language, "AT_ONCE", 0)
    assert np.allclose(language.fit([counts], pieces), whole)


def test_identify_against_brute_force(spark):
    """Every segmentation of every word is listed, for fitting and for scoring."""
    import random

    rng = random.Random(8)
    texts = {"aa": "das der und ist ein wir", "bb": "the and is one we of", "cc": "le la et est un nous"}
    rows = [(k, " ".join(rng.choice(texts[lang].split()) for _ in range(rng.randint(1, 6))), lang) for k in range(40) for lang in [rng.choice(sorted(texts))]]
    rows += [(50, "und the et", None), (51, None, "aa"), (52, "12 ?", "bb"), (None, "der die das", "aa"), (53, "Das THE un", "cc")]
    pieces = set(language.vocabulary(PIECES))
    learned = [r for r in rows if r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1)]
    langs = sorted({r[2] for r in learned})

    def ways(word):
        for s in segmentations("▁" + word):
            if all(len(x) == 1 or x in pieces for x in s):
                yield s

    def chance(way, p):
        return np.prod([p[x] if x in pieces else language.FLOOR for x in way])

    fitted = {}
    for lang in langs:
        words = [w for r in learned if r[2] == lang for w in language.words_of(r[1] or "")]
        p = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(language.ROUNDS):
            seen = dict.fromkeys(pieces, language.ADDED)
            for w in words:
                every = [(s, chance(s, p)) for s in ways(w)]
                total = sum(c for _, c in every)
                for s, c in every:
                    for x in s:
                        if x in pieces:
                            seen[x] += c / total
            total = sum(seen.values())
            p = {x: n / total for x, n in seen.items()}
        fitted[lang] = p
    want = {}
    for i, text, _ in rows:
        words = language.words_of(text or "")
        if not words:
            want[i] = ("und", 0.0)
            continue
        logs = np.array([np.log(sum(r[2] == lang for r in learned) / len(learned)) + sum(np.log(sum(chance(s, fitted[lang]) for s in ways(w))) for w in words) for lang in langs])
        calm = np.exp((logs - logs.max()) / np.sqrt(len(words)))
        want[i] = (langs[int(logs.argmax())], 1 / calm.sum())
    got = language.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1])


def test_fit_raises_the_likelihood():
    pieces = language.vocabulary(PIECES)
    counts = {"straße": 3, "haus": 5, "häuser": 2, "und": 9}
    table, longest = language.Table(language.piece_hashes(pieces)), max(map(len, pieces))

    def likelihood(rounds):
        p = language.fit([counts], pieces, rounds)
        assert p[:-1].sum() == pytest.approx(1)
        return sum(n * x for n, x in zip(counts.values(), language.log_probabilities(table, p, longest, list(counts))[:, 0], strict=True))

    assert likelihood(1) < likelihood(3)


def test_table_finds_what_it_holds():
    keys = np.random.default_rng(1).integers(1, 2**63, 40_000).astype(np.uint64)
    t = language.Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) == -1).all()


def test_language_held_out(spark):
    docs = common.table(spark, SF, "documents")
    got = {r.doc_id: r for r in language.identify(spark, docs, PIECES).collect()}
    known = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [known[i] == r.lang_pred for i, r in got.items() if r.held_out]
    assert len(got) == len(known) and np.mean(held) > 0.97


def test_language_edges(spark, docs, rows, no_docs):
    got = language.identify(spark, docs, PIECES).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (140, 141, 142, 143)] == ["und"] * 4 and by[147].lang_pred != "und"
    assert language.identify(spark, no_docs, PIECES).collect() == []
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in language.identify(spark, docs.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}
