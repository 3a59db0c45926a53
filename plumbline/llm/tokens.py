"""Token ids in fixed-width bit-packed files.

A file holds the ids of many documents, one after another, each id in the
fewest bits that can hold the vocabulary. Ids are cut into blocks of a fixed
number of ids; every block starts on a byte and its offset is stored, so a
reader unpacks any stretch of ids with numpy, without the blocks before it.

Layout, little-endian::

    magic(8)  bits(u32)  block_tokens(u32)
    blocks    ceil(n * bits / 8) bytes each
    docs      Arrow stream: doc_id, start, n_tokens, label
    index     n_blocks x (offset u64, crc32 u32)
    trailer   docs_at, docs_len, index_at, n_blocks, n_tokens (u64 each), magic(8)
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

MAGIC = b"PLTOKEN1"
HEAD = struct.Struct("<8sII")
TRAILER = struct.Struct("<QQQQQ8s")
INDEX = np.dtype([("offset", "<u8"), ("crc", "<u4")])
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("label", pa.string())])


def width(vocabulary: int) -> int:
    """Fewest bits that tell `vocabulary` ids apart."""
    return max(1, math.ceil(math.log2(max(2, vocabulary))))


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (unsigned, each below 2**bits) in `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    if not len(ids):
        return b""
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The inverse of pack, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    if not n:
        return np.zeros(0, "<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (planes.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


#: Words of printable ASCII but the apostrophe, and Latin letters that lower() maps to one letter: their
#: normal form is their lower case, and their pre-tokens are runs of letters, single digits and runs of the rest.
PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: The byte-level alphabet: a byte that is a printable Latin-1 character is itself, the others follow from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


#: Parts of a tokenizer file under which the ids of a text are those of its words (fixed values).
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class Encoder:
    """Ids of whole texts by a `tokenizers` file, with a cache of words.

    The vocabulary's normaliser and pre-tokeniser never join anything across
    ASCII white space, so the ids of a text are those of its words in turn. That
    holds for files with the normaliser and pre-tokeniser of KNOWN; texts of any
    other file take the plain path, the tokenizer's own. The cache is cleared at
    `limit` words, so memory stays bounded. Texts that could hold a special
    token's string take the plain path too.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.cache: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        named = [t["content"] for t in parts.get("added_tokens", [])]
        self.word_by_word = {k: parts.get(k) for k in KNOWN} == KNOWN and all(t.startswith("<|") for t in named)

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def plain(self, data: bytes) -> bytes:
        ids = self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def run(self, part: str) -> bytes:
        """Ids of one pre-token in lower case, letters of the byte-level alphabet standing for its UTF-8 bytes."""
        key = part.encode()
        if key not in self.cache:
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else key.decode("latin-1").translate(BYTE_LETTERS))]
            self.cache[key] = struct.pack(f"<{len(ids)}I", *ids)
        return self.cache[key]

    def learn(self, words: set[bytes]) -> None:
        rest = []
        for w in words:
            text = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(text):
                self.cache[w] = b"".join([self.run(part) for part in RUNS.findall(text.lower())])
            else:
                rest.append((w, text))
        if rest:
            found = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
            for (w, _), e in zip(rest, found, strict=True):
                self.cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, data: bytes) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        if not self.word_by_word or b"<|" in data:
            return self.plain(data)
        words = (data.lower() if data.isascii() else data).split()
        new = {w for w in set(words) if w not in self.cache}
        if new:
            if len(self.cache) + len(new) > self.limit:
                self.cache.clear()
                new = set(words)
            self.learn(new)
        cache = self.cache
        return b"".join([cache[w] for w in words])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Writes one file, block by block."""

    def __init__(self, stream, bits: int, block_tokens: int = 1 << 16):
        self.stream, self.bits, self.block = stream, bits, block_tokens
        self.at = HEAD.size
        stream.write(HEAD.pack(MAGIC, bits, block_tokens))
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.tokens = 0
        self.index: list[tuple[int, int]] = []
        self.docs: dict[str, list] = {k: [] for k in DOCS.names}

    def add(self, doc_id: int | None, ids: np.ndarray, label: str | None = None) -> None:
        for k, v in zip(DOCS.names, (doc_id, self.tokens, len(ids), label), strict=True):
            self.docs[k].append(v)
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, whole, self.block):
            data = pack(ids[k : min(k + self.block, whole)], self.bits)
            self.index.append((self.at, zlib.crc32(data)))
            self.stream.write(data)
            self.at += len(data)
        self.waiting = [ids[whole:]] if whole < len(ids) else []
        self.held = len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCS) as out:
            out.write_batch(pa.RecordBatch.from_pydict(self.docs, schema=DOCS))
        docs = sink.getvalue().to_pybytes()
        index = np.array(self.index, INDEX).tobytes() if self.index else b""
        self.stream.write(docs)
        self.stream.write(index)
        self.stream.write(TRAILER.pack(self.at, len(docs), self.at + len(docs), len(self.index), self.tokens, MAGIC))
        self.stream.close()


class Reader:
    """Reads one file: documents in turn, or any stretch of ids."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size))
        docs_at, docs_len, index_at, blocks, self.tokens, end = TRAILER.unpack(self._read(file.size() - TRAILER.size, TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token file, or one that was cut off")
        self.docs = pa.ipc.open_stream(self._read(docs_at, docs_len)).read_all()
        self.index = np.frombuffer(self._read(index_at, blocks * INDEX.itemsize), INDEX)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("a token file ends early")
        return data

    def _block(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            n = min(self.block, self.tokens - k * self.block)
            data = self._read(int(self.index["offset"][k]), (n * self.bits + 7) // 8)
            if zlib.crc32(data) != self.index["crc"][k]:
                raise ValueError(f"block {k} of a token file is damaged")
            self.last = (k, unpack(data, n, self.bits))
        return self.last[1]

    def stretch(self, start: int, n: int) -> np.ndarray:
        """ids start .. start + n of the file."""
        parts = []
        while n > 0:
            k, off = divmod(start, self.block)
            part = self._block(k)[off : off + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray, str | None]]:
        for batch in self.docs.to_batches(max_chunksize=4096):
            for doc_id, start, n, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield doc_id, start, self.stretch(start, n) if n else np.zeros(0, "<u4"), label


MANIFEST = "part int, path string, label string, n_docs long, n_tokens long"


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, label: str | None = None) -> DataFrame:
    """Encode each partition of docs (doc_id, text, the label's column) to one file; lazy.

    Returns a row for each file and label (MANIFEST). Rows keep the order they
    have in their partition. A task that runs again writes a file of another
    name, and only the names in the rows that Spark committed are read.
    """

    def task(batches):
        enc = encoder(tokenizer)
        bits = width(max(enc.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        path = f"{folder}/{common.attempt_name()}.tok"
        fs, p = common.filesystem(path)
        writer, totals = None, {}
        for batch in batches:
            writer = writer or Writer(fs.open_output_stream(p), bits)
            labels = batch.column(2).to_pylist() if label else [None] * batch.num_rows
            for doc_id, data, name in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), labels, strict=True):
                ids = np.frombuffer(enc.encode(data) + end, "<u4")
                writer.add(doc_id, ids, name)
                t = totals.setdefault(name, [0, 0])
                t[0] += 1
                t[1] += len(ids)
        if writer:
            writer.close()
            part = common.part_id()
            rows = [{"part": part, "path": path, "label": k, "n_docs": n, "n_tokens": t} for k, (n, t) in totals.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("label", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(label).cast("string").alias("label")] if label else [])]
    return docs.select(*columns).mapInArrow(task, MANIFEST)


def open_file(path: str) -> Reader:
    fs, p = common.filesystem(path)
    return Reader(fs.open_input_file(p))


def encode_in_order(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[tuple[str, int, int]]:
    """Token files in ascending doc_id order: (path, ids of all files before it, ids in it).

    A range partitioning by doc_id and the text's start puts the order across files, a sort within
    each partition the order in them. The list has a row for each file, so its
    length is the number of partitions, whatever the corpus holds.
    """
    start = F.substring("text", 1, 32)  # so that the rows of one doc_id, or of none, may lie in many files
    ordered = docs.select("doc_id", "text").repartitionByRange(common.partitions(spark), F.col("doc_id"), start).sortWithinPartitions("doc_id", "text")
    files = sorted(write_files(ordered, folder, tokenizer, end_id).collect(), key=lambda r: r.part)
    out, before = [], 0
    for r in files:
        out.append((r.path, before, r.n_tokens))
        before += r.n_tokens
    return out


DOC_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def read_documents(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """A row for each document of the files: its place, length and the crc32 of its ids."""

    def task(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, ids, _ in open_file(path):
                    rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes()), path.rpartition("/")[2]))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    listed = spark.createDataFrame([(p, b) for p, b, _ in files], "path string, before long")
    return common.spread(listed, len(files), "path").mapInArrow(task, DOC_ROWS)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs to token files in ascending doc_id order, and read the files back.

    Nulls: a null text is empty (its ids are the end id alone); a null doc_id
    sorts first and stays null. Repeated doc_ids are separate documents, ordered
    by text. A text of any length is encoded whole.
    An empty table gives no files and no rows. Other columns are ignored.
    """
    scratch = common.Scratch(spark, "tokens")
    files = encode_in_order(spark, docs, scratch.folder("files"), tokenizer, end_id)
    return read_documents(spark, files)
