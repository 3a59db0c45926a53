"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, exact_dedup, language, media, mixing, near_dedup, packing, quality, sharding, tokens, warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(spark, common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_media(spark, common.table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, common.table(spark, sf_dir, "documents")).drop("row")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(spark, common.table(spark, sf_dir, "documents")).drop("class_id")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, common.table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_media_chunks, op3_exact_dedup, op4_warc, op5_near_dedup, op6_shards, op7_quality, op8_packing, op9_language, op10_mixing)}
SQL = {"op3_exact_dedup": exact_dedup.SQL, "op4_warc": warc.SQL, "op5_near_dedup": near_dedup.SQL, "op6_shards": sharding.SQL, "op10_mixing": mixing.SQL}
