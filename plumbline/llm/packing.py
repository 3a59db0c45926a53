"""Mixture-controlled packing of token streams into fixed-length sequences.

Every source is a queue of token ids, its documents one after another. Windows
are filled by deficit round-robin: at each window a source's deficit grows by
its quantum (its share of the window), the whole tokens of the deficit are
served from its queue, and the fraction is carried to the next window. Quanta
are exact fractions, so the deficit that a partition inherits at window w is
(quantum * w) modulo 1, known without running the windows before it: deficits
carry across partitions as they do across windows, and no task waits for another.

All windows in turn make one stream, which is cut every `length` tokens. Only
the last sequence can be short.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import common, tokens

#: A task keeps the starts of MAX_WINDOWS windows for so many queues; with more queues, of fewer windows.
MAX_QUEUES, MAX_WINDOWS = 512, 4096


@dataclass(frozen=True)
class Phase:
    """A run of windows in which the same queues are active.

    quota[q] tokens of queue q are served over `windows` windows; first[q] is the
    queue's position, and start the stream's, when the phase begins.
    """

    windows: int
    quota: tuple[int, ...]
    first: tuple[int, ...]
    start: int

    def served(self, q: int, w: int) -> int:
        """Tokens of queue q served in this phase before its window w."""
        return self.quota[q] * w // self.windows

    def window_of(self, q: int, x: int) -> int:
        """The window that serves token x of the queue, counted from the phase's begin."""
        return -(-(x + 1) * self.windows // self.quota[q]) - 1

    @cached_property
    def _quota(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each queue in every window, and what is left over: products of the two with a window stay in 64 bits."""
        return np.divmod(np.array(self.quota, np.int64), self.windows)

    def starts(self, w: int) -> np.ndarray:
        """Where each queue's part of window w begins in the stream, and where the window ends.

        One round of the robin: deficit = carried remainder + quota, the whole part is served.
        """
        whole, rest = self._quota
        out = np.full(len(whole) + 1, self.start + int((whole * w + rest * w // self.windows).sum()), np.int64)
        out[1:] += np.cumsum(whole + (rest * w % self.windows + rest) // self.windows)
        return out


def plan(totals: list[int], weights: list[float] | None, window: int) -> list[Phase]:
    """Phases that serve all tokens; while a queue lasts it gets its weight among those that last.

    Without weights each queue's weight is its own total, and one phase serves all.
    """
    left = list(totals)
    wanted = [float(t) for t in totals] if weights is None else [max(0.0, float(w)) for w in weights]
    first, start, phases = [0] * len(totals), 0, []
    while any(left):
        active = [q for q, n in enumerate(left) if n]
        share = {q: wanted[q] for q in active}
        if not any(share.values()):  # only queues of no weight are left
            share = {q: float(left[q]) for q in active}
        ends = min((left[q] / share[q] for q in active if share[q] > 0), default=0.0)
        quota = [0] * len(totals)
        for q in active:
            exact = left[q] if share[q] > 0 and left[q] / share[q] <= ends else int(ends * share[q])
            quota[q] = min(left[q], exact)
        total = sum(quota)
        phases.append(Phase(max(1, -(-total // window)), tuple(quota), tuple(first), start))
        first = [a + b for a, b in zip(first, quota, strict=True)]
        left = [a - b for a, b in zip(left, quota, strict=True)]
        start += total
    return phases


def pieces_of(phases: list[Phase], q: int, position: int, n: int, length: int, cache: dict) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the n tokens that begin at a position of queue q."""
    out = []
    for k, phase in enumerate(phases):
        end = phase.first[q] + phase.quota[q]
        while n and position < end:
            x = position - phase.first[q]
            w = phase.window_of(q, x)
            if (k, w) not in cache:
                if len(cache) > MAX_WINDOWS * MAX_QUEUES // max(len(phase.quota), MAX_QUEUES):
                    cache.clear()
                cache[k, w] = phase.starts(w)
            here = phase.served(q, w)
            take = min(n, phase.served(q, w + 1) - x)
            at = int(cache[k, w][q]) + x - here
            position, n = position + take, n - take
            while take:
                sequence, offset = divmod(at, length)
                m = min(take, length - offset)
                if out and out[-1][0] == sequence and out[-1][1] + out[-1][2] == offset:
                    out[-1] = (sequence, out[-1][1], out[-1][2] + m)
                else:
                    out.append((sequence, offset, m))
                at, take = at + m, take - m
        if not n:
            break
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, label string"


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, window_sequences: int = 32, weights: dict[str | None, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Pack all docs (doc_id, text, source) into sequences of `length` tokens; a row for each piece.

    `weights` gives the sources' token proportions in every window while they
    last; without it they are the sources' own shares of the corpus. with_ids
    adds the ids themselves (binary, unsigned 32-bit little-endian).

    Texts are read and encoded once, to token files in the shared folder; what
    Spark moves between tasks is a row for each file and source.

    Nulls: a null text is empty (its ids are the end id alone); a null doc_id
    stays null; null is a source of its own. Repeated rows are separate
    documents. A long text is cut over as many sequences as it needs. An empty
    table gives no rows. Other columns are ignored.
    """
    scratch = common.Scratch(spark, "packing")
    docs = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    manifest = scratch.keep(tokens.write_files(docs, scratch.folder("files"), tokenizer, end_id, "source"), "manifest")
    sums = sorted(manifest.groupBy("label").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: (r.label is None, r.label or ""))
    queues = {r.label: q for q, r in enumerate(sums)}
    phases = plan([r.n for r in sums], None if weights is None else [weights.get(r.label, 0.0) for r in sums], length * window_sequences)
    before = F.sum("n_tokens").over(Window.partitionBy("label").orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("path").agg(F.collect_list("label").alias("labels"), F.max(F.when(F.col("label").isNull(), F.col("before"))).alias("null_before"), F.collect_list(F.when(F.col("label").isNotNull(), F.col("before"))).alias("befores"))

    def task(batches):
        cache: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                position = dict(zip(row["labels"], row["befores"], strict=True)) | {None: row["null_before"]}
                rows: list[tuple] = []
                for doc_id, _, ids, label in tokens.open_file(row["path"]):
                    at, begin = position[label], 0
                    position[label] = at + len(ids)
                    for sequence, offset, n in pieces_of(phases, queues[label], at, len(ids), length, cache):
                        data = ids[begin : begin + n].tobytes()
                        rows.append((doc_id, begin, n, zlib.crc32(data), len(ids), sequence, offset, label, data)[: 9 if with_ids else 8])
                        begin += n
                    if len(rows) >= 4096:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "label", *["ids"] * with_ids]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n_files = manifest.select("path").distinct().count()
    return common.spread(files, n_files, "path").mapInArrow(task, PIECES + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, n_tokens, ids (padded), doc_ids.

    A group has at most `length` tokens. A short sequence is padded to `length`,
    but for one whose size is a power of two already. Null doc_ids stay null, a
    document of several pieces in a sequence is named for each, and no pieces
    give no sequences; other columns are ignored.
    """
    n = F.col("n_tokens")
    padded = F.rpad(F.col("ids"), 4 * length, F.lit(int(pad_id).to_bytes(4, "little")))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", F.hex("ids").alias("ids")))).alias("p"))
        .select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.unhex(F.array_join(F.col("p.ids"), "")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
        .withColumn("ids", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(padded))
    )
