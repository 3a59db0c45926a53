import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import common, exact_dedup, mixing, quality
from plumbline.llm.queries import QUERIES, SQL, tokenizer_path
from tests.llm.test_dedup import UPPER, brute_classes

TABLES = ("documents", "pages", "labels")


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.project(", ".join(columns)).fetchall()))


def check_pieces(pieces, docs):
    """Pieces against the plain tokenizer's ids of docs (doc_id, text), repeats counted: each id lies in one piece, sequences have no gaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in {t or "" for _, t in docs}}
    copies = defaultdict(Counter)  # by doc_id and number of tokens: how often each text is there
    for i, t in docs:
        copies[i, len(ids[t or ""])][t or ""] += 1
    covered = defaultdict(Counter)
    for p in pieces:
        fits = [t for t in copies[p.doc_id, p.doc_tokens] if zlib.crc32(struct.pack(f"<{p.length}I", *ids[t][p.start : p.start + p.length])) == p.ids_crc32]
        assert fits and p.length > 0
        covered[p.doc_id, p.doc_tokens].update(range(p.start, p.start + p.length))
    assert {k: sum(v.values()) for k, v in copies.items()}.keys() == covered.keys()
    for (i, n), texts in copies.items():
        assert covered[i, n] == Counter(dict.fromkeys(range(n), sum(texts.values())))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(len(ids[t or ""]) for _, t in docs)
    assert total <= 2048 * len(sequences) < total + 2048 * 2


def test_stages(spark, sf_dir):
    """Each stage against plain Python on what the stage before kept, and run() against the chain."""
    docs = common.table(spark, sf_dir, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = []
    scratch = common.Scratch(spark, "stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    raw = common.table(spark, sf_dir, "documents")
    model = quality.train(spark, raw, common.table(spark, sf_dir, "labels"))
    presses = quality.Presses(model.good, model.bad)
    good = [r for r in raw.collect() if quality.score(model, presses, (r.text or "").encode()) >= 0.3]
    assert sorted(kept[0]) == sorted(good)
    last = {}
    for r in good:
        key = exact_dedup.normal((r.text or "").encode())
        last[key] = max(last.get(key, r), r, key=lambda x: x.doc_id)
    assert sorted(kept[1]) == sorted(last.values())
    assert sorted(r.doc_id for r in kept[2]) == sorted(one_of_each([(r.doc_id, r.text) for r in last.values()], 0))
    third = spark.createDataFrame(kept[2], raw.schema)
    times = {r.doc_id: r.times for r in mixing.mix(spark, third).collect()}
    assert sorted(r.doc_id for r in kept[3]) == sorted(d for d, n in times.items() for _ in range(n))
    mixed = [(r.doc_id, r.text) for r in kept[3]]
    check_pieces(kept[4], mixed)
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), mixed)


def one_of_each(rows, column=None):
    """Of each near-duplicate class the row with the least doc_id (null last), then SHA-256; every row without words."""
    groups = defaultdict(list)
    for r, c in zip(rows, brute_classes(rows), strict=True):
        groups[c].append(r)
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())) for g in groups.values()]
    return first if column is None else [r[column] for r in first]


def test_stages_on_awkward_rows(spark, docs, rows, no_docs, tmp_path):
    """Nulls, repeats and clashing names: each stage keeps what it should, no more and no less."""
    sf = str(tmp_path)
    spark.createDataFrame([(k, int(k % 7 != 0), 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    one = corpus_pipeline.quality_stage(spark, docs, sf)
    assert one.columns == corpus_pipeline.COLUMNS
    exact = corpus_pipeline.exact_stage(spark, docs, sf).collect()
    assert sorted((r.text or "").translate(UPPER) for r in exact) == sorted({(r[1] or "").translate(UPPER) for r in rows})
    near = corpus_pipeline.near_stage(spark, docs, sf).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in near), key=key) == sorted(((r[0], r[1]) for r in one_of_each(rows)), key=key)
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    mixed = common.Scratch(spark, "t").keep(mixed, "mixed")
    times = {(r.doc_id, r.text): r.times for r in mixing.mix(spark, docs).collect()}
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter({k: n * times[k] for k, n in Counter((r[0], r[1]) for r in rows).items() if times[k]})
    check_pieces(corpus_pipeline.packing_stage(spark, mixed, sf).collect(), [(r.doc_id, r.text) for r in mixed.collect()])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).collect() == []
    frame = spark.createDataFrame([tuple(r[:4]) + (0,) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")  # no files to tell places
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        assert sorted(map(str, (tuple(r)[:4] for r in stage(spark, frame, sf).collect()))) == sorted(map(str, (tuple(r)[:4] for r in stage(spark, docs, sf).collect())))
