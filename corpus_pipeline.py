"""The training-data pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``, whatever others there are
and whatever their names.  In all stages a null doc_id is a value as any other, rows
that agree in all columns are documents each unless a stage says otherwise, and an
empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import op2_mixing, op4_packing, op7_quality, op8_lines, op9_partenum
from weftline.session import drop_scratch, materialize, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes; a null language is a language without
    common words.  Equal texts of one language go or stay together.
    """
    return op7_quality.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; every document stays.

    A null text stays null, a text that loses all its lines stays as an empty one.  Of
    equal passages that of the smallest doc_id stays, null last, of one id that of the
    smallest text hash; rows that agree in doc_id and text keep or lose the same lines.
    """
    return op8_lines.clean(docs, passages=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    That of the smallest doc_id, null last, of one id that of the smallest text hash;
    of rows that agree in both one.  Rows without words, null texts among them, all stay.
    """
    return op9_partenum.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: 0, 1 or 2 times, as rows that are equal.

    A document without words is not taken.  The null source is a source, ranked last.
    """
    return op2_mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in token sequences, one row a piece.

    A null text is an empty one, a piece of one end id.  Rows are packed each on its own.
    """
    return op4_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the signatures, the pivotal draws and the tokenizer; tests/llm/test_registered.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as made:  # a stage's own tables go when its rows are written
            docs = materialize(stage(spark, docs, sf_dir), name)
            made.pop()
        if before is not None:
            drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
