"""Five stages from raw documents to packed sequences; counted as part of subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm.decontaminate import drop_leaks
from episodica.llm.packing import pack
from episodica.llm.pii import redact
from episodica.llm.quality import keep_good
from episodica.llm.shared import fresh_path, table
from episodica.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, each judged by its own text: null, empty and very short texts go, repeated rows share a verdict."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that of the least id (null: the largest); of repeated rows one, too.

    Null and empty texts have the same fingerprint, so one of them stays.
    """
    return keep_one(docs, repeated=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a benchmark item. Null and empty texts have none; repeated rows share a verdict; without items all rows stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind, and n_chars the new length. Null texts stay null, repeated rows are replaced each."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences: a null or empty text is one piece, the end id; repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: Suffix arrays, fingerprints and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again. An empty table gives an empty result at each stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
