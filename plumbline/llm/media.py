"""Media payloads as content-defined chunks, stored once and reconstructed.

A payload is stored as a grey image (binary PGM, 64 samples a row), which holds
its bytes as 8-bit samples without loss. The image's bytes are cut where a
rolling gear hash has its top bits zero, so equal stretches give equal chunks
wherever they stand. Chunks go to pack files: zstandard blocks, with a
recipe (the ordered chunk list) for each document.

1. Each partition writes a pack of its distinct chunks, and reports a digest
   for each.
2. Spark finds each digest's owner (the first partition and chunk that has it)
   by a grouped minimum, and joins it back to all holders.
3. Each pack is written anew with the chunks that it owns, the first one is
   removed; recipes are resolved to (pack, block, offset) by a second join.
4. Documents are put together from their own and other packs, and the image's
   SHA-256 is compared with the one taken at the start.

What Spark shuffles are digests and places. Payloads move from file to file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

UNIT = 64
#: Least, mean (a power of two) and largest bytes of a chunk.
LEAST, MEAN, MOST = 512, 2048, 16384
#: Bytes of chunks compressed together.
BLOCK = 1 << 20
#: zstandard level of the first packs, which are short-lived, and of the stored ones.
LEVELS = (9, 12)
MAGIC = b"PLPACK01"
TRAILER = struct.Struct("<QQ8s")


def _gear() -> np.ndarray:
    """The gear table: splitmix64's first 256 outputs, upper halves."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte: the sum of the last 32 bytes' gear values, each shifted by its distance (mod 2**32).

    The recurrence h = 2h + gear[b] is unrolled by doubling: sums over 1, 2, 4,
    8, 16, 32 bytes, each from two of the one before.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, 2 * span
    return h


def cut_points(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST, piece: int = 1 << 20) -> list[int]:
    """Ends of the chunks of data; the last is len(data)."""
    shift = np.uint32(32 - (mean.bit_length() - 1))
    ends, start, n = [], 0, len(data)
    for a in range(0, n, piece):
        head = min(a, 31)
        h = gear_hashes(data[a - head : a + piece])[head:]
        for at in (np.flatnonzero((h >> shift) == 0) + a + 1).tolist():
            while at - start > most:
                start += most
                ends.append(start)
            if at - start >= least and at < n:
                ends.append(at)
                start = at
    while n - start > most:
        start += most
        ends.append(start)
    if n > start:
        ends.append(n)
    return ends


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def image(data: bytes) -> bytes:
    """data (a multiple of UNIT bytes) as a binary PGM of UNIT samples a row."""
    return b"P5\n%d %d\n255\n" % (UNIT, len(data) // UNIT) + data


def samples(media: bytes) -> bytes:
    """The samples of a PGM that image() wrote."""
    kind, size, top, data = media.split(b"\n", 3)
    w, h = map(int, size.split())
    if kind != b"P5" or top != b"255" or len(data) != w * h:
        raise ValueError("not an 8-bit grey image")
    return data


def feature(data: bytes) -> str:
    """Mean, spread and 16-bin histogram of the samples, and their mean step, in integers."""
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    mean = int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    bins = np.bincount(x >> 4, minlength=16) * 1000 // n
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) if n > 1 else 0
    return f"mean={mean * 1000 // n};var={(square * n - mean * mean) // (n * n)};step={step * 1000 // n};hist=" + ",".join(map(str, bins))


class PackWriter:
    """Chunks into compressed blocks, then the recipes (Arrow) and a trailer."""

    def __init__(self, path: str, level: int):
        import zstandard

        fs, p = common.filesystem(path)
        self.stream = fs.open_output_stream(p)
        self.press = zstandard.ZstdCompressor(level=level)
        self.stream.write(MAGIC)
        self.at, self.block, self.waiting = 8, bytearray(), []
        self.places: dict[int, tuple[int, int, int, int]] = {}

    def add(self, number: int, chunk: bytes) -> None:
        self.waiting.append((number, len(self.block), len(chunk)))
        self.block += chunk
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            data = self.press.compress(bytes(self.block))
            self.stream.write(data)
            for number, off, n in self.waiting:
                self.places[number] = (self.at, len(data), off, n)
            self.at += len(data)
            self.block, self.waiting = bytearray(), []

    def close(self, recipes: bytes) -> None:
        self.flush()
        self.stream.write(recipes)
        self.stream.write(TRAILER.pack(self.at, len(recipes), MAGIC))
        self.stream.close()


class PackReader:
    """Chunks of any pack by place, with the last blocks kept; and a pack's recipes."""

    def __init__(self, blocks: int = 16):
        import zstandard

        self.press = zstandard.ZstdDecompressor()
        self.files: OrderedDict[str, object] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], bytes] = OrderedDict()
        self.most = blocks

    def file(self, path: str):
        if path not in self.files:
            fs, p = common.filesystem(path)
            self.files[path] = fs.open_input_file(p)
            if len(self.files) > 32:
                self.files.popitem(last=False)[1].close()
        return self.files[path]

    def read(self, path: str, at: int, n: int) -> bytes:
        f = self.file(path)
        f.seek(at)
        return f.read(n)

    def chunk(self, path: str, at: int, size: int, off: int, n: int) -> bytes:
        key = (path, at)
        if key in self.blocks:
            self.blocks.move_to_end(key)
        else:
            self.blocks[key] = self.press.decompress(self.read(path, at, size), max_output_size=BLOCK + MOST)
            if len(self.blocks) > self.most:
                self.blocks.popitem(last=False)
        return self.blocks[key][off : off + n]

    def recipes(self, path: str) -> bytes:
        size = self.file(path).size()
        at, n, end = TRAILER.unpack(self.read(path, size - TRAILER.size, TRAILER.size))
        if end != MAGIC:
            raise ValueError("a pack was cut off")
        return self.read(path, at, n)


RECIPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("chunks", pa.list_(pa.int32()))])
CHUNKS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("digest", pa.binary()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int32()), ("off", pa.int32()), ("n", pa.int32())])
CHUNKS_DDL = "part long, chunk long, digest binary, path string, at long, size int, off int, n int"
PLACES_DDL = "owner long, path string, at long, size int, off int, n int"


def _first_packs(folder: str):
    def task(batches):
        part, path = common.part_id(), f"{folder}/{common.attempt_name()}.pack"
        writer, numbers = None, {}
        sink = pa.BufferOutputStream()
        recipes = pa.ipc.new_stream(sink, RECIPES)
        for batch in batches:
            writer = writer or PackWriter(path, LEVELS[0])
            rows: dict[str, list] = {k: [] for k in RECIPES.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True):
                media = image(payload(text))
                start, own = 0, []
                for end in cut_points(media):
                    chunk = media[start:end]
                    start = end
                    digest = hashlib.blake2b(chunk, digest_size=20).digest()
                    number = numbers.get(digest)
                    if number is None:
                        number = numbers[digest] = len(numbers)
                        writer.add(number, chunk)
                    own.append(number)
                for k, v in zip(RECIPES.names, (doc_id, len(text), hashlib.sha256(media).hexdigest(), own), strict=True):
                    rows[k].append(v)
            recipes.write_batch(pa.RecordBatch.from_pydict(rows, schema=RECIPES))
        if writer is None:
            return
        recipes.close()
        writer.close(sink.getvalue().to_pybytes())
        digests = list(numbers)
        for a in range(0, len(digests), 4096):
            some = range(a, min(a + 4096, len(digests)))
            places = [writer.places[k] for k in some]
            yield pa.RecordBatch.from_pydict({"part": [part] * len(places), "chunk": list(some), "digest": digests[a : a + 4096], "path": [path] * len(places)} | {k: [x[i] for x in places] for i, k in enumerate(("at", "size", "off", "n"))}, schema=CHUNKS)

    return task


def _sealed_packs(folder: str):
    """Writes a pack of the owned chunks alone, in their order, with the first pack's recipes."""

    def task(batches):
        reader = PackReader()
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/{int(row['part']):07d}-{common.attempt_name()}.pack"
                writer = PackWriter(path, LEVELS[1])
                for c in sorted(row["own"] or [], key=lambda c: c["chunk"]):
                    writer.add(c["chunk"], reader.chunk(row["path"], c["at"], c["size"], c["off"], c["n"]))
                writer.close(reader.recipes(row["path"]))
                owners = [(row["part"] << 32) + k for k in writer.places]
                places = list(writer.places.values())
                # a pack that owns nothing is still the home of its recipes: owner -1 - part names it
                owners.append(-1 - row["part"])
                places.append((0, 0, 0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([path] * len(owners)), *[pa.array([p[i] for p in places], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]], names=["owner", "path", "at", "size", "off", "n"])

    return task


MEDIA_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def _read_back(with_payload: bool):
    names = [x.split()[0] for x in MEDIA_DDL.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()] + [pa.binary()] * with_payload

    def task(batches):
        reader = PackReader()
        for batch in batches:
            for row in batch.to_pylist():
                place = {c["chunk"]: c for c in row["chunks"] or []}
                for recipe in pa.ipc.open_stream(reader.recipes(row["home"])):
                    rows = []
                    for doc_id, n_bytes, sha, chunks in zip(*(c.to_pylist() for c in recipe.columns), strict=True):
                        media = b"".join(reader.chunk(*(place[k][x] for x in ("path", "at", "size", "off", "n"))) for k in chunks)
                        if hashlib.sha256(media).hexdigest() != sha:
                            raise ValueError(f"document {doc_id}: its chunks do not give its media back")
                        data = samples(media)
                        rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), sha, feature(data), len(chunks), data)[: len(names)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return task


def store_media(spark: SparkSession, docs: DataFrame, with_payload: bool = False) -> DataFrame:
    """Store every text of docs (doc_id, text) as chunked media, read all back, and describe it.

    A row for each document: doc_id, n_bytes (of the text), payload_bytes,
    payload_sha256, tail_crc32 (of the last 64 payload bytes), media_bytes,
    media_sha256, feature, n_chunks; with_payload adds the payload.

    A null text is empty: its payload is 64 zero bytes. A null doc_id stays
    null; repeated rows are separate documents that share all chunks. A long text
    has as many chunks as its cuts give. An empty table gives no rows; other
    columns are ignored.
    """
    scratch = common.Scratch(spark, "media")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = scratch.keep(docs.mapInArrow(_first_packs(scratch.folder("first")), CHUNKS_DDL), "chunks")
    own = F.shiftleft("part", 32) + F.col("chunk")
    owners = scratch.keep(chunks.groupBy("digest").agg(F.min(own).alias("owner")), "owners")
    # a digest has a row for each partition that holds it, no more
    resolved = scratch.keep(chunks.join(owners, "digest").drop("digest"), "resolved")
    packs = chunks.groupBy("part").agg(F.first("path").alias("path"))
    n_packs = packs.count()
    owned = resolved.filter(F.col("owner") == own).groupBy("part").agg(F.collect_list(F.struct("chunk", "at", "size", "off", "n")).alias("own"))
    places = scratch.keep(common.spread(packs.join(owned, "part", "left").select("part", "path", "own"), n_packs, "part").mapInArrow(_sealed_packs(scratch.folder("packs")), PLACES_DDL), "places")
    scratch.drop("first")
    homes = places.filter("owner < 0").select((-1 - F.col("owner")).alias("part"), F.col("path").alias("home"))
    located = resolved.select("part", "chunk", "owner").join(places, "owner")
    lists = located.groupBy("part").agg(F.collect_list(F.struct("chunk", "path", "at", "size", "off", "n")).alias("chunks"))
    recipes = homes.join(lists, "part", "left").select("home", "chunks")
    return common.spread(recipes, n_packs, "home").mapInArrow(_read_back(with_payload), MEDIA_DDL + ", payload binary" * with_payload)
