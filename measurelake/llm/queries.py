"""The registered query of each operator, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.llm import annpart, bpe, jaccard, langcrf, linededup, mixing, preference, quality, rules, urlrules
from measurelake.llm.common import fold, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.read_ranks(RANKS), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    gone = F.aggregate("removed_spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    return out.select("doc_id", gone.cast("long").alias("removed_lines"), F.size("removed_spans").cast("long").alias("removed_runs"), F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The hand-written rules that go before the mined ones.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.mine(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(preference.pairs(preference.conversations(table(spark, sf_dir, "conversations"))))
    counted = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + F.when(s["mask"], F.length(s["text"])).otherwise(0)).cast("long")
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_completion", "rejected_completion", counted("chosen_segments").alias("chosen_loss_chars"), counted("rejected_segments").alias("rejected_loss_chars"))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langcrf.fit(docs.where(~held_out))
    return langcrf.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annpart.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_url_filters": op6_url_filters,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_language_crf": op9_language_crf,
    "op10_learned_partitions": op10_learned_partitions,
}
ORACLES: dict[str, str] = {}
