"""Quality by compression: which of two zstandard dictionaries fits a text better.

One dictionary is built from good, one from bad labelled text. A text is cut
into blocks of BLOCK bytes, each compressed with either dictionary, so that the
dictionary counts and not the text's own past. The difference of the two sizes
over the text's length is its lean. A logistic curve over the lean, fitted on
labelled texts that built neither dictionary, makes it a score. The curve's
slope changes at quantiles of the bad texts' leans, since leans crowd there, and
is nowhere negative.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Labelled documents of either class that training reads: the documented bound of the sample.
PER_CLASS = 1500
#: Bytes of a block, bytes of a dictionary.
BLOCK, DICTIONARY = 512, 110 * 1024
LEVEL = 3
#: Bytes added to the length in a lean, which draws very short texts to 0.
CALM = 64
#: Quantiles of the bad texts' leans at which the curve's slope changes.
KNOTS = (0.75, 0.95)


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the curve: knots, and the slope from minus infinity and from each knot on; none if nothing was learned."""

    good: bytes
    bad: bytes
    knots: tuple[float, ...]
    height: float
    slopes: tuple[float, ...]
    prior: float


def dictionary(blocks: list[bytes]) -> bytes:
    """A zstandard dictionary of the blocks; all of them, one after another, where zstandard finds them too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, k=1000, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)


def blocks_of(text: bytes) -> list[bytes]:
    return [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]


class Presses:
    """The two compressors of a model."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def press(data: bytes):
            if len(data) < 8:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = press(good), press(bad)

    def lean(self, text: bytes) -> float:
        """Above 0: the good dictionary fits better."""
        g = b = 0
        for a in range(0, len(text), BLOCK):
            block = text[a : a + BLOCK]
            g += len(self.good.compress(block))
            b += len(self.bad.compress(block))
        return (b - g) / (len(text) + CALM)


def bends(leans: np.ndarray, knots: tuple[float, ...]) -> np.ndarray:
    """A column for the lean and one for its excess over each knot."""
    return np.column_stack([leans, *[np.maximum(0.0, leans - k) for k in knots]])


def curve(leans: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float, tuple[float, ...]]:
    """Knots, height at lean 0 (as if no knot lay below) and slopes of the logistic curve."""
    knots = tuple(float(k) for k in np.quantile(leans[y == 0], KNOTS))
    mean, spread, w = calibrate(bends(leans, knots), y, weight)
    steps = w[1:] / spread
    slopes = np.maximum(0.0, np.cumsum(steps))
    steps = np.diff(slopes, prepend=0.0)
    return knots, float(w[0] - mean @ steps), tuple(float(s) for s in steps)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights of the columns of x by Newton steps, on columns of mean 0 and spread 1."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + penalty * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def score(model: Model, presses: Presses, text: bytes) -> float:
    if not text or not model.slopes:
        return model.prior
    x = presses.lean(text)
    z = model.height + model.slopes[0] * x + sum(s * max(0.0, x - k) for s, k in zip(model.slopes[1:], model.knots, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from at most per_class labelled documents of either class.

    labels has doc_id and quality (0 or 1; a document labelled twice counts as
    1 if any says so). Documents are drawn by a hash of their id. Of each class
    every second one builds the dictionary, the others calibrate. With one
    class, or none, the model scores every text by the share of label 1.
    """
    scratch = common.Scratch(spark, "quality")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    draw = F.xxhash64(F.col("doc_id"), F.lit(7))
    drawn = [known.filter(F.col("quality") == q).orderBy(draw, "doc_id").limit(per_class) for q in (0, 1)]
    ids = scratch.keep(drawn[0].unionByName(drawn[1]), "ids")  # at most 2 x per_class rows, so it may be broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(ids.select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality"))), F.col("doc_id") == F.col("of")).select("doc_id", "text", "quality")
    sample = scratch.keep(sample.withColumn("builds", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(2)) == 0), "sample")

    def blocks(batches):
        for batch in batches:
            found = [(q, b) for q, t in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True) for b in blocks_of(t)]
            yield pa.RecordBatch.from_pydict({"quality": pa.array([q for q, _ in found], pa.int32()), "block": pa.array([b for _, b in found], pa.binary())})

    # the texts of at most 2 x per_class documents
    built = sample.filter("builds").select("quality", "text").mapInArrow(blocks, "quality int, block binary").orderBy("quality", "block").collect()
    parts = {q: [bytes(r.block) for r in built if r.quality == q] for q in (0, 1)}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    good, bad = dictionary(parts[1]), dictionary(parts[0])
    model = Model(good, bad, (), 0.0, (), prior)
    packed = pickle.dumps((good, bad))

    def measure(batches):
        presses = Presses(*pickle.loads(packed))
        for batch in batches:
            found = [(q, presses.lean(t)) for q, t in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True) if t]
            yield pa.RecordBatch.from_pydict({"quality": pa.array([x[0] for x in found], pa.int32()), "lean": pa.array([x[1] for x in found], pa.float64())})

    rows = sample.filter("not builds").select("quality", "text").mapInArrow(measure, "quality int, lean double").orderBy("quality", "lean").collect()
    scratch.release()
    y = np.array([r.quality for r in rows], float)
    if not parts[0] or not parts[1] or len(set(y)) < 2:
        return model
    # each class weighs as in all labels, not as in the sample
    weight = np.where(y == 1, prior * len(y) / y.sum(), (1 - prior) * len(y) / (len(y) - y.sum()))
    return Model(good, bad, *curve(np.array([r.lean for r in rows]), y, weight), prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score (double, 0 to 1) by the text alone. A null or empty text gets the share of label 1."""
    packed = pickle.dumps(model)
    columns = [f for f in docs.schema.fields if f.name != "score"]
    docs = docs.select(*[f.name for f in columns])
    at = docs.columns.index("text")

    def task(batches):
        m = pickle.loads(packed)
        presses = Presses(m.good, m.bad)
        for batch in batches:
            scores = [score(m, presses, t) for t in common.text_bytes(batch.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(task, StructType([*columns, StructField("score", DoubleType())]))


def rate(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each of docs; held-out labels are not learned from.

    A document is held out if crc32 of its id as text is 0 modulo `folds`. A
    null doc_id is not held out and has no label. Repeated rows score alike; a
    text of any length is scored whole. An empty table gives no rows; other columns are ignored, as is the rest of
    docs when a text is scored.
    """
    common.prepare(spark)
    model = train(spark, docs, labels.filter(~common.held_out(F.col("doc_id"), folds, 0)))
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", common.held_out(F.col("doc_id"), folds, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
