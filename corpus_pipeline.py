"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents. run() writes each stage as Parquet in the
shared folder and reads it back as the next one's docs. An empty table goes
through every stage as one. Columns of docs other than COLUMNS are left out, so
their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, exact_dedup, mixing, near_dedup, packing, quality
from plumbline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score below are rejected.
THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. It learns from all labels.

    A null or empty text has the score of no evidence, the share of good labels,
    and goes or stays by it; a long text is scored whole. Repeated rows are
    scored alike, each for itself; labels of a null doc_id are not read.
    """
    common.prepare(spark)
    model = quality.train(spark, docs, common.table(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(*COLUMNS), model).filter(F.col("score") >= THRESHOLD).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal after lower-casing A-Z: the one with the largest doc_id.

    Of rows that tie in doc_id too, one. Null and empty texts are one group; a
    null doc_id is below all others. Rows are told apart by their place in the
    table, so repeated rows go too.
    """
    scratch = common.Scratch(spark, "exact-stage")
    docs = common.placed(scratch, docs.select(*COLUMNS))
    found = exact_dedup.exact_dedup(spark, docs, carry=(common.FILE, common.PLACE))
    return common.without(scratch, docs, found.filter("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one with the smallest doc_id, then the least SHA-256 of its text.

    Of rows that tie in both, the first by place. A null doc_id is above all
    others here, so such a row stays only where its component has no other. A
    null text, or one without words, is in no component and stays.
    """
    scratch = common.Scratch(spark, "near-stage")
    docs = common.placed(scratch, docs.select(*COLUMNS))
    found = near_dedup.near_dedup(spark, docs, carry=(common.FILE, common.PLACE)).filter("class_id is not null")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256", common.FILE, common.PLACE)
    found = scratch.keep(found.select("class_id", one.alias("one")), "found")
    heads = found.groupBy("class_id").agg(F.min("one").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dropped = found.join(heads.select(F.col("class_id").alias("of"), "head"), F.col("class_id") == F.col("of")).filter("one <> head")
    return common.without(scratch, docs, dropped.select(f"one.{common.FILE}", f"one.{common.PLACE}"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never or several times.

    A null source is a source of its own; a text without words counts 0 words and
    is taken as often as its source's whole repetitions say. Rows that repeat a
    doc_id and text are taken alike.
    """
    mixed = mixing.mix(spark, docs.select(*COLUMNS))
    return mixed.filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Every row is packed, repeated ones each for itself; a null or empty text is
    its end id alone; a long text is cut over as many sequences as it needs.
    """
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier and the packing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        for other in list(common.Scratch.live):
            if other is not scratch:
                other.release()
    return docs
