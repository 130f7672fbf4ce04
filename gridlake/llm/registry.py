"""Queries over the driver's tables, one for each training-data operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import ann, bpe, chat, langid, licenses, packing, pii, quality, simhash, sql, substring

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: ``source/hundred/id.txt``; one whose first line holds a license cue is a licence file, and every tenth such lies one directory up."""
    shelf = F.concat_ws("/", "source", F.expr("doc_id div 100"))
    first = F.substring_index("text", "\n", 1)
    path = F.when(~first.rlike(licenses.CUE), F.concat(shelf, F.lit("/"), "doc_id", F.lit(".txt")))
    path = path.when(F.col("doc_id") % 10 == 0, F.concat("source", F.lit("/LICENSE."), "doc_id")).otherwise(F.concat(shelf, F.lit("/LICENSE."), "doc_id"))
    return docs.select("doc_id", path.alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(document_paths(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), redacted=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_account", "n_url")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: A conversation whose texts hold the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.conversations(chat.reply_paths(chat.from_turns(rows.unionByName(extra)))))
    return read.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.fit_and_identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_best_fit_packing,
        op2_license_scan,
        op3_quality_rules,
        op4_personal_data,
        op5_byte_bpe,
        op6_nearest_vectors,
        op7_substring_dedup,
        op8_simhash_groups,
        op9_chat_format,
        op10_language_id,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op2_license_scan": sql.license_scan(), "op7_substring_dedup": sql.SUBSTRING, "op9_chat_format": sql.CHAT}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
