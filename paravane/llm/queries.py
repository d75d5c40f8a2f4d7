"""The ten operators as registered queries, and the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.llm import ann, bpe_tree, decontaminate, html_extract, jaccard_join, langid, oracle, passages, quality, token_count, toxicity
from paravane.llm.common import fold, labelled, table

#: Where the public vocabularies are; they are never copied into the repository.
RANKS, TOKENIZER = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"
#: Documents with more tokens than this are over the limit.
TOKEN_LIMIT = 512


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a row's id falls into the fold that is not learned from; a null id does not."""
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.filter(fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability; learned from labels.quality outside the held-out fold."""
    found = quality.grade(table(spark, sf_dir, "documents"), labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", "rating"))
    return found.select("doc_id", held_out(4, 2), "expected_grade", "tail_prob", "selected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", "toxic"))
    return found.select("doc_id", held_out(4, 2), "score", "predicted")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", top=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # the url travels with the key, so the pages need no join afterwards
    found = html_extract.extract(pages.select(F.struct("page_id", "url").alias("page_id"), "html"))
    return found.select("page_id.page_id", "page_id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more: a row for each later copy, with the document of the first."""
    return passages.find(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("bigint(length(token_ids) div 4)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items leaked into documents, one row for each document and item."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_language_id, op2_quality, op3_nearest_neighbours, op4_html_text, op5_passages, op6_jaccard_join, op7_bpe_roundtrip, op8_token_counts, op9_toxicity, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
