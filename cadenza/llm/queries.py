"""The query of each operator with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, id_coder, jaccard_join, media_columns, quote_links, secret_ledger, suffix_dedup, token_counts, weak_toxicity
from .shared import table


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.linked_conversations(table(spark, sf_dir, "conversations"))


def op2_label_model_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_context_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = id_coder.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return id_coder.read_ids(segments, keep_ids=False)


def op4_prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = secret_ledger.scan(table(spark, sf_dir, "documents"), path="doc_id")
    return secret_ledger.digest(found)


def op8_bitmap_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op9_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.flac_columns(table(spark, sf_dir, "documents"), keep_media=False)


def op10_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), keep_bytes=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quote_links, op2_label_model_toxicity, op3_context_mixing_blocks, op4_prefix_containment, op5_size_aware_jaccard, op6_heap_token_counts, op7_blob_ledger, op8_bitmap_queue_bpe, op9_flac_columns, op10_induced_sorting)
}
