"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all documents that its predecessor kept and returns the columns of ``documents``; the last
returns the packed pieces.

Results for odd input, in every stage but the last: a null text is left null and counts as empty; a null ``doc_id`` is
scored like any other and takes no part in the stages that compare documents, which keep it; rows that repeat a
``doc_id`` with one text are one document and all go or stay, with different texts each is judged on its own text;
further columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docketspark.llm import line_dedup, minhash_dedup, packing, quality, substring_dedup
from docketspark.llm.shared import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 stay."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), least=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the largest of them only."""
    return line_dedup.clean_lines(docs, min_docs=3, min_chars=20)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the smallest stays."""
    return minhash_dedup.keep_one(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the smallest document that holds them only."""
    return substring_dedup.clean_passages(docs, least=50, shingle=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", pack),
]
#: No SQL expresses the trained classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps goes through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
