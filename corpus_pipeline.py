"""From raw documents to token ids: the text operators one after another.

Every stage gets what the one before kept, and what it rejects is gone. Nulls and empty texts have no
language and end in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard, langid, toxicity
from millrace.llm.common import staged
from millrace.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that their column ``lang`` teaches: half of the text at least."""
    return langid.accepted(docs, langid.learn(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose windows compress like toxic text."""
    return toxicity.accepted(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each component of documents with a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words windows of benchmark items hit a twentieth or more."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in place of its text, with their number; other columns stay."""
    ids = bpe.encode(docs, tokenizer_path())
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("toxicity", toxic), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: No SQL trains a dictionary or runs expectation maximisation; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
