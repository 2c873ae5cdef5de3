"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gridlens.llm import decontaminate, hard_negatives, html_extract, kneser_ney, line_dedup, mixing, near_dup, quality_fm, quality_rules, quotes, sharding, suffix_dedup, token_alignment

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.in_reply_order(quotes.quote_threads(_table(spark, sf_dir, "conversations")))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(_table(spark, sf_dir, "documents"))


def op5_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), metadata=("n_chars",))


def op7_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), share=0.5)
    return mixed.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_chance", "mix_drawn")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.corpus_scores(_table(spark, sf_dir, "documents"))


def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(_table(spark, sf_dir, "documents"))


def op12_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op13_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_quote_threads": op2_quote_threads,
    "op3_line_chunks": op3_line_chunks,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_block_rules": op5_block_rules,
    "op6_factorisation_machine": op6_factorisation_machine,
    "op7_threshold_rules": op7_threshold_rules,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_raked_mixture": op9_raked_mixture,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_pair_alignment": op11_pair_alignment,
    "op12_column_suffixes": op12_column_suffixes,
    "op13_hilbert_zones": op13_hilbert_zones,
    "pipeline": corpus_pipeline.run,
}

#: The other operators rest on hashes that DuckDB does not have, or on fitted models; brute-force tests cover them.
SQL: dict[str, str] = {
    "op2_quote_threads": quotes.SQL,
    "op7_threshold_rules": quality_rules.sql(),
    "op12_column_suffixes": suffix_dedup.SQL,
    "op13_hilbert_zones": hard_negatives.SQL,
}
