"""The queries op1 to op13 over the driver's tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation, decontaminate, html, jaccard, katz, langid, mih, pii, resample, tokenstore, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The tokenizer of op5 and op10, and the end id of op5.
WORD_BPE, END_ID = "word_bpe_49k.json", 2


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.held_out(_table(spark, sf_dir, "documents"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"), pii.learn(pii.examples(spark)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.damaged_and_audited(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_decontamination, op4_jaccard_components, op5_token_store, op6_html_text, op7_katz, op8_multi_index_hashing, op9_warc, op10_bpe, op11_importance_resampling, op12_personal_data, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.ORACLE, "op4_jaccard_components": jaccard.ORACLE, "op9_warc": warc.ORACLE, "op11_importance_resampling": resample.ORACLE}
