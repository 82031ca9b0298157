"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Rows with null or empty text pass through every stage with the defined results of its operator: the classifier scores
them by its bias, they are near duplicates of each other, hold no benchmark passage and no secret, and have no ids. Rows
with a null id are kept like any other. Repeated rows and ties: one of a group of near duplicates stays, that of the
smallest id, and of equal ids the first row. Empty tables pass as such. All columns are kept up to the last stage, whatever
their names; long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import bpe, decontaminate, quality, secrets, simhash
from tidewake.llm.common import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.fold() == 1)
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, an estimated similarity of 0.8 or more) stays."""
    return simhash.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    return secrets.remove_secrets(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", byte_bpe),
]
#: The classifier cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
