"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each partition fingerprints its texts, sorts the distinct fingerprints, cuts
   them by owner (a range of fingerprint space) and sends each owner its range
   as Golomb codes of the gaps, with a bitmap of those it holds twice itself.
2. Each owner decodes the lists it got and answers each with a bitmap: which of
   its fingerprints another list holds too, or the sender twice.
3. The partitions read their texts again. Texts whose bit is unset are unique.
   The others are suspects: equal ones of a partition are joined byte by byte
   there, one text of each is shuffled, and equal bytes meet.

A fingerprint has log2(documents) + SPARE bits only, so that the exchange is
small; what collides costs a comparison, never a wrong answer.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm import common

#: Fingerprint bits beyond log2 of the number of documents: about one text in 2**SPARE is a false suspect.
SPARE = 12


def golomb_encode(values: np.ndarray, r: int) -> bytes:
    """Sorted distinct unsigned values as Golomb codes of their gaps, with divisor 2**r.

    Quotients stand in unary in one stream, remainders in r bits each in a
    second one, so that both unpack by whole arrays.
    """
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(r)).astype(np.int64)
    ends = np.cumsum(quotients) + np.arange(len(gaps))
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary, bitorder="little").tobytes()
    rests = ((gaps[:, None] >> np.arange(r, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<I", len(head)) + head + np.packbits(rests.ravel(), bitorder="little").tobytes()


def golomb_decode(data: bytes, n: int, r: int) -> np.ndarray:
    """The n values that golomb_encode coded."""
    if not n:
        return np.zeros(0, np.uint64)
    (size,) = struct.unpack_from("<I", data)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 4), bitorder="little"))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + size), bitorder="little", count=n * r).reshape(n, r)
    rests = (bits.astype(np.uint64) << np.arange(r, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(r)) + rests, dtype=np.uint64)


def rice_parameter(span: int, n: int) -> int:
    """The divisor's exponent for n values spread over a range of `span`."""
    return max(0, (span // max(1, n)).bit_length() - 1)


def normal(text: bytes) -> bytes:
    """A to Z in lower case, nothing else changed."""
    return text.lower()


def fingerprint(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - bits)


MESSAGES = "owner long, part int, n long, r int, codes binary, twice binary"
ANSWERS = "part int, owner long, n long, r int, codes binary, bits binary"


def _send(bits: int, owner_bits: int):
    def task(batches):
        mine = []
        for batch in batches:
            mine.append(np.fromiter((fingerprint(hashlib.sha256(normal(t)).digest(), bits) for t in common.text_bytes(batch.column(0))), np.uint64, batch.num_rows))
        if not mine:
            return
        values, counts = np.unique(np.concatenate(mine), return_counts=True)
        span = bits - owner_bits
        owners = (values >> np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(values)), strict=True):
            r = rice_parameter(1 << span, int(b - a))
            local = values[a:b] & np.uint64((1 << span) - 1)
            rows.append({"owner": int(owners[a]), "part": common.part_id(), "n": int(b - a), "r": r, "codes": golomb_encode(local, r), "twice": np.packbits(counts[a:b] > 1, bitorder="little").tobytes()})
        for k in range(0, len(rows), 512):
            yield pa.RecordBatch.from_pylist(rows[k : k + 512], schema=pa.schema([("owner", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("r", pa.int32()), ("codes", pa.binary()), ("twice", pa.binary())]))

    return task


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's part: which fingerprints occur in two lists, or twice in one."""
    lists = [golomb_decode(c, n, r) for c, n, r in zip(pdf["codes"], pdf["n"], pdf["r"], strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bits = []
    for own, twice in zip(lists, pdf["twice"], strict=True):
        local = np.unpackbits(np.frombuffer(twice, np.uint8), bitorder="little", count=len(own)).astype(bool)
        bits.append(np.packbits(local | np.isin(own, shared, assume_unique=True), bitorder="little").tobytes())
    return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "n": pdf["n"], "r": pdf["r"], "codes": pdf["codes"], "bits": bits})


def _store(folder: str, span: int):
    """Writes a partition's answers as one file: sorted fingerprints, then a flag for each."""

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("owner")
        values = [golomb_decode(c, n, r) + np.uint64(int(o) << span) for c, n, r, o in zip(pdf["codes"], pdf["n"], pdf["r"], pdf["owner"], strict=True)]
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little", count=n) for b, n in zip(pdf["bits"], pdf["n"], strict=True)]
        fs, p = common.filesystem(f"{folder}/part={int(key[0])}")
        fs.create_dir(p, recursive=True)
        with fs.open_output_stream(f"{p}/{common.attempt_name()}.bits") as out:
            n = sum(map(len, values))
            out.write(struct.pack("<Q", n) + np.concatenate(values).astype("<u8").tobytes() + np.concatenate(flags).tobytes())
        return pd.DataFrame({"part": [int(key[0])], "n": [n]})

    return task


def _load(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """A partition's answers. Attempts of one task write the same; a file that was cut off is passed over."""
    fs, p = common.filesystem(f"{folder}/part={part}")
    for x in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
        with fs.open_input_stream(x.path) as f:
            data = f.read()
        n = struct.unpack_from("<Q", data)[0] if len(data) >= 8 else -1
        if len(data) == 8 + 9 * n:
            return np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n)
    return np.zeros(0, np.uint64), np.zeros(0, np.uint8)


ROWS = [("doc_id", pa.int64()), ("row", pa.int64()), ("sha", pa.string()), ("local", pa.int64()), ("text", pa.binary())]
ROWS_DDL = "doc_id long, row long, sha string, local long, text binary"


def _look(folder: str, bits: int, schema: pa.Schema):
    """Second reading. local is null for a text known to be unique, else its group in this partition.

    The first row of a local group carries the text. A fingerprint that the
    partition did not send itself (its rows were dealt otherwise this time) is
    taken for a suspect.
    """

    def task(batches):
        part = common.part_id()
        values, flags = _load(folder, part)
        groups: dict[bytes, int] = {}
        row = 0
        for batch in batches:
            texts = [normal(t) for t in common.text_bytes(batch.column(1))]
            digests = [hashlib.sha256(t).digest() for t in texts]
            own = np.fromiter((fingerprint(d, bits) for d in digests), np.uint64, len(digests))
            at = np.minimum(np.searchsorted(values, own), max(0, len(values) - 1))
            suspect = np.ones(len(own), bool) if not len(values) else (values[at] != own) | (flags[at] != 0)
            local, kept = [], []
            for text, s in zip(texts, suspect, strict=True):
                if not s:
                    local.append(None)
                    kept.append(None)
                    continue
                known = groups.get(text)  # compares bytes
                kept.append(None if known is not None else text)
                if known is None:
                    known = groups[text] = (part << 36) + len(groups)
                local.append(known)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(range((part << 36) + row, (part << 36) + row + n), pa.int64()), pa.array([d.hex() for d in digests]), pa.array(local, pa.int64()), pa.array(kept, pa.binary()), *batch.columns[2:]], schema=schema)
            row += n

    return task


def exact_dedup(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal if identical after lower-casing A to Z. Of equal texts the
    row with the largest doc_id is kept; of rows that tie in doc_id too, one.
    A null text is empty; a null doc_id is below all others; a text of any
    length is compared whole. `row` numbers the rows within this result. An empty
    table gives no rows; other columns are ignored, but for those named in
    `carry`, which the result has too.
    """
    scratch = common.Scratch(spark, "exact")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    carried = [f for f in docs.schema.fields if f.name in carry]
    schema = pa.schema([*ROWS, *[(f.name, to_arrow_type(f.dataType)) for f in carried]])
    ddl = ", ".join([ROWS_DDL, *[f"`{f.name}` {f.dataType.simpleString()}" for f in carried]])
    n = max(1, docs.count())
    bits = min(63, (n - 1).bit_length() + SPARE)
    owner_bits = min(bits - 1, max(3, (4 * max(common.partitions(spark), n // 500_000)).bit_length()))
    messages = docs.select("text").mapInArrow(_send(bits, owner_bits), MESSAGES)
    answers = messages.groupBy("owner").applyInPandas(_answer, ANSWERS)
    folder = scratch.folder("answers")
    scratch.keep(answers.groupBy("part").applyInPandas(_store(folder, bits - owner_bits), "part int, n long"), "sent")
    rows = scratch.keep(docs.mapInArrow(_look(folder, bits, schema), ddl), "rows")

    unique = rows.filter("local is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "row", *carry)
    suspects = rows.filter("local is not null").select("doc_id", "row", "sha", "local", *carry)
    best = F.max(F.struct(F.col("doc_id").alias("id"), (-F.col("row")).alias("at")))
    locals_ = suspects.groupBy("local").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    texts = rows.filter("text is not null").select("local", "sha", "text")
    equal = Window.partitionBy("sha", "text")  # a row for each partition that holds the text
    groups = texts.join(locals_, "local").select(F.col("local").alias("of"), F.max("best").over(equal).alias("best"), F.sum("n").over(equal).alias("group_size"))
    groups = scratch.keep(groups, "groups")
    repeated = suspects.join(groups, F.col("local") == F.col("of")).select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.at")).alias("kept"), F.col("sha").alias("text_sha256"), "row", *carry)
    return unique.unionByName(repeated)


#: Rows-for-rows SQL of the query over documents.
SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
