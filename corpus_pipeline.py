"""The corpus pipeline: stages over `documents`, each of one operator of measurelake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents. Rows without doc_id pass the stages that need one
unchanged, and drop out where documents are compared or mixed; a null or empty text is a document without words, texts
of any length are read whole. Other columns pass whatever their names; an empty table passes every stage empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from measurelake.llm import bpe, jaccard, linededup, mixing, quality
from measurelake.llm.common import discard, materialize, table, unused, words

#: Scores under this are rejected.
LEAST_SCORE = 0.3
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; learned from `labels`. Repeated rows are judged alike."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "__score")
    return quality.score(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) >= LEAST_SCORE).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words or more that an earlier one has; those left without a word by that go."""
    out = linededup.dedup_lines(docs)
    return out.where((F.size("removed_spans") == 0) | (F.size(words(F.col("text"))) > 0)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a similarity of 0.8 on five-word shingles.

    Of rows that repeat a doc_id the one of the least text stays; null and empty texts link with nothing.
    """
    kept = jaccard.link(docs, n=5, least=(80, 100)).where("doc = component").select(F.col("doc").alias("doc_id")).distinct()
    own = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *(F.xxhash64(c) for c in docs.columns if c not in ("doc_id", "text")))
    place = unused(docs, "__place")
    return docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(own)).where(F.col(place) == 1).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to whole copies: 0 to 3. Texts without words go; repeated rows are one document."""
    copied, copy = unused(docs, "__copies"), unused(docs, "__copy")
    taken = mixing.mix(docs).where("2 * taken >= size AND size > 0")
    copies = taken.groupBy("doc", "version").agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias(copied))
    out = docs.join(copies, (docs["doc_id"] == copies["doc"]) & (F.xxhash64(docs["text"]) == copies["version"]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copied)))).select(*(docs[c] for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    return bpe.encode_documents(docs, bpe.read_ranks(RANKS), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("ngram_jaccard", dedup_near), ("mixing", mix), ("byte_bpe", encode)]
#: Learned scores and hash orders decide here; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        before, docs = docs, materialize(out, f"stage-{name}")
        if k:
            discard(before)
