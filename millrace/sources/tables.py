"""Reading tables, and the corpus view of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence lines and the names they stand for, in order of precedence.
LICENSE_LINES = (
    ("MIT License", "mit"),
    ("Apache License, Version 2.0", "apache-2.0"),
    ("GNU General Public License", "gpl-3.0"),
    ("CC BY-NC", "cc-by-nc-4.0"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, lang, text, license (from its line in the text) and content_hash."""
    docs = table(spark, folder, "documents")
    license = F.coalesce(*[F.when(F.contains("text", F.lit(line)), name) for line, name in LICENSE_LINES], F.lit("unknown"))
    return docs.select("doc_id", "source", "lang", "text", license.alias("license"), F.sha2("text", 256).alias("content_hash"))


#: The same in SQL, as the beginning of oracle statements.
CORPUS_SQL = (
    "corpus as (select doc_id, source, lang, text, case "
    + " ".join(f"when contains(text, '{line}') then '{name}'" for line, name in LICENSE_LINES)
    + " else 'unknown' end license, sha256(text) content_hash from documents)"
)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, corrupt rows): blank lines are skipped, corrupt ones are listed with their file and text.

    A byte order mark before the first line is dropped.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where("row._corrupt is null").select("row.*").drop("_corrupt")
    bad = parsed.where("row._corrupt is not null").select("file", F.substring("value", 1, 240).alias("snippet"))
    return good, bad


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables, missing columns null, with content_hash filled from the text."""
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    have = F.col("content_hash") if "content_hash" in out.columns else F.lit(None).cast("string")
    return out.withColumn("content_hash", F.coalesce(F.nullif(have, F.lit("")), F.sha2("text", 256)))


def write_shards(rows: DataFrame, path: str, rows_per_shard: int) -> None:
    """JSON lines in files of at most so many rows, in place of what was there."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).json(path)
