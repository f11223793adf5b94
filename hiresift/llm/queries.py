"""Registered queries of this folder: each applies its operator to its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hiresift.llm import bpe_automaton, chat, decontaminate, manifest, near_dedup, packing, phrases, quality, token_counts, token_file, topk, toxicity, wrappers
from hiresift.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op6_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(spark, table(spark, sf_dir, "conversations"))


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"))


def op9_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_file.write_token_file(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    return token_file.read_token_file(segments)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.lower_cased_thirds)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


ALL = (
    op1_mixture_packing, op2_benchmark_leaks, op3_maxscore_topk, op4_pairwise_quality, op5_page_wrappers, op6_chat_prefixes, op7_section_tokens,
    op8_order_minhash, op9_toxic_sentences, op10_simple8b_tokens, op11_merkle_manifest, op12_phrase_collocations, op13_bpe_automaton,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}
ORACLES: dict[str, str] = {"op11_merkle_manifest": manifest.oracle(), "op12_phrase_collocations": phrases.oracle()}
