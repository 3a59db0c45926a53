import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import tokens
from plumbline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@given(st.integers(1, 32), st.data())
def test_pack_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=80)), "<u4")
    packed = tokens.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    assert (tokens.unpack(packed, len(ids), bits) == ids).all()


def test_width():
    assert [tokens.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_random_access(bits):
    class Sink(io.BytesIO):
        def close(self):
            pass

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    rng = np.random.default_rng(1)
    sink = Sink()
    w = tokens.Writer(sink, bits, block_tokens=64)
    docs = [rng.integers(0, 2**bits, n).astype("<u4") for n in (0, 1, 63, 64, 65, 500, 3)]
    for k, d in enumerate(docs):
        w.add(k, d, "s")
    w.close()
    r = tokens.Reader(Source(sink.getvalue()))
    everything = np.concatenate(docs)
    assert r.tokens == len(everything)
    for a, n in [(0, 5), (60, 10), (130, 300), (len(everything) - 1, 1)]:
        assert (r.stretch(a, n) == everything[a : a + n]).all()
    assert all((ids == docs[k]).all() for k, _, ids, _ in r)
    damaged = bytearray(sink.getvalue())
    damaged[40] ^= 1
    with pytest.raises(ValueError):
        list(tokens.Reader(Source(bytes(damaged))))


def test_word_cache_gives_the_tokenizers_ids(plain, rows):
    enc = tokens.Encoder(PATH, limit=50)
    for _, text, *_ in rows:
        assert np.frombuffer(enc.encode((text or "").encode()), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids
        assert len(enc.cache) <= 50 or len(enc.cache) <= len(set((text or "").split()))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b ̱́'sStdHKİΣς")), max_size=40))
def test_word_cache_on_any_text(text):
    from tokenizers import Tokenizer

    if not hasattr(test_word_cache_on_any_text, "t"):
        test_word_cache_on_any_text.t = Tokenizer.from_file(PATH)
        test_word_cache_on_any_text.e = tokens.Encoder(PATH)
    want = test_word_cache_on_any_text.t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(test_word_cache_on_any_text.e.encode(text.encode()), "<u4").tolist() == want


def test_files_against_plain_encoding(spark, docs, rows, plain):
    got = tokens.token_files(spark, docs, PATH).collect()
    want = sorted(((r[0], r[1] or "", r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, (r[1]).encode()))
    expected, at = [], 0
    for doc_id, text, _ in want:
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((s, d, n, c) for d, s, n, c in expected)


def test_empty(spark, no_docs):
    assert tokens.token_files(spark, no_docs, PATH).collect() == []


def test_another_tokenizer_file_takes_its_own_path():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.word_by_word and tokens.Encoder(PATH).word_by_word
    for text in ("Two  words", " a\tb\n\nC", "don't", ""):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
