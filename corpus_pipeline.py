"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  Null or empty texts
pass the filters (they are neither toxic, nor copies, nor leaks); an empty
table passes through every stage.

Rows without an id: the toxicity stage judges them like others; the stages that
name documents by their id (copies, passages, leaks) keep them as they are.
Rows of one id count as one document for these stages: if one of its texts is a
copy of a smaller id's or a leak, all of its rows go, and passages are cut from
all its rows at the places found.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.llm import bpe_tree, decontaminate, jaccard_join, passages, toxicity
from paravane.llm.common import discard, fit_to_send, labelled, passing, shared_folder, table

#: The rank file of the last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row): the whole row travels as the key and holds the text, so results need no join with the documents."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not listed."""
    return docs.join(fit_to_send(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar predicts to be toxic go."""
    scored = toxicity.score(whole_rows(docs), labelled(docs, table(spark, sf_dir, "labels"), "toxic", "toxic"), id_col="row", text_col=None)
    return scored.filter("predicted = 0 OR doc_id.text IS NULL OR trim(doc_id.text) = ''").select("doc_id.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles the smallest id stays."""
    groups = jaccard_join.components(docs, k=5, num=80, den=100)
    return without(docs, groups.filter("component_id <> doc_id"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat an earlier document are cut from the later ones."""
    kept = passages.remove(docs, passages.find(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window alike to a benchmark item go."""
    return without(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token identifiers; text is what these decode to."""
    coded = bpe_tree.encode_decode(whole_rows(docs), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, id_col="row", text_col=None)
    own = [F.decode("decoded", "UTF-8").alias("text") if c == "text" else F.col(f"doc_id.{c}") for c in docs.columns]
    return coded.select(*own, F.expr("bigint(length(token_ids) div 4)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_tokens),
]

#: SQL cannot express the learned stages; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage left in the shared folder goes when its table is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
