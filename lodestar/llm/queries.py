"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import (
    alignment,
    best_fit,
    byte_bpe,
    chat,
    exact_dedup,
    html_extract,
    language,
    line_dedup,
    near_dedup,
    packing,
    prefix_trie,
    quality,
    suffix_dedup,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.learned(docs.where(~language.held_out())))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2).drop("digest")


def packed_documents(docs: DataFrame) -> DataFrame:
    return packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn(
        "ids_crc32", F.crc32("ids")
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents")).drop("ids")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.formatted(turns, public_tokenizers.path("byte_bpe_50k.json")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    digests = byte_bpe.decoded(ids.withColumn("ids_sha256", F.sha2("ids", 256)), ranks)
    return digests.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).drop("row")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.regrown(prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit.packed_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.linked(table(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extract,
        op2_exact_dedup,
        op3_language_id,
        op4_near_dedup,
        op5_packing,
        op6_chat_format,
        op7_byte_bpe,
        op8_line_dedup,
        op9_quality_rules,
        op10_suffix_array_dedup,
        op11_prefix_trie,
        op12_best_fit_packing,
        op13_token_alignment,
    )
}
