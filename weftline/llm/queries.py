"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import op1_sharding, op2_mixing, op3_store, op4_packing, op5_licenses, op6_nndescent, op7_quality, op8_lines, op9_partenum, op10_quotes, op11_runs, op12_suffixes, op13_interaction

from weftline.llm.oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sharding.shard_documents(_documents(spark, sf_dir))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.mix_documents(_documents(spark, sf_dir))


def op3_content_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return op3_store.store_documents(_documents(spark, sf_dir), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op4_histogram_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return op4_packing.pack_documents(_documents(spark, sf_dir), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op5_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licenses.license_documents(_documents(spark, sf_dir))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_nndescent.dedup_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality.quality_documents(_documents(spark, sf_dir))


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lines.dedup_lines(_documents(spark, sf_dir))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lines.dedup_lines(_documents(spark, sf_dir), passages=True)


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_partenum.component_ids(_documents(spark, sf_dir))


def op10_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quotes.threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_runs.run_documents(_documents(spark, sf_dir))


def op12_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_suffixes.suffix_documents(_documents(spark, sf_dir))


def op13_first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_interaction.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_hash_tree,
        op2_pivotal_mix,
        op3_content_store,
        op4_histogram_pack,
        op5_rare_token_licenses,
        op6_nn_descent,
        op7_divergence_rules,
        op8_line_windows,
        op8_passages,
        op9_partenum_join,
        op10_quote_threads,
        op11_block_runs,
        op12_two_stage_suffixes,
        op13_first_failures,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
