"""The pipeline over ``documents``: each stage applies one operator to all rows that the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from rosterloom.llm.queries import table
from rosterloom.session import checkpoint_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the limit; the model is fitted on the labelled ones.

    Null and empty texts have no words and are judged by the thresholds alone, long texts as wholes, repeated rows
    alike; an empty table, or one without both labels, loses nothing; all columns are kept, also ones named like the score.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 and more over five-word shingles connect.

    Null and empty texts are linked with nothing, as are rows without a ``doc_id``, which stay; rows that share a
    ``doc_id`` become one; the smallest ``doc_id`` stays, so there are no ties; all columns are kept.
    """
    return jaccard_join.keep_one(docs, words=5, percent=80)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none; repeated rows are judged alike; an empty benchmark loses nothing; all columns are kept.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted again where it was there.

    A null text stays null with a null count, an empty one has 0; repeated rows are masked alike; other columns are kept.
    """
    redacted = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences.

    Null and empty texts have the end id alone; long texts are cut; repeated rows are packed each; an empty table gives
    no rows; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_copies),
    ("decontaminate", without_leaks),
    ("secret_scan", without_secrets),
    ("harmonic_packing", packed),
]
# The model, the entropy scan and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again as the next stage's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
