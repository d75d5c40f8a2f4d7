"""Task loaders: raw benchmark tables to (id, x, y, meta, row_idx)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paravane.functions import text as T
from paravane.functions.parsers import RELATION
from paravane.operators.clean import keep_first
from paravane.registry import register_dataset


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``row_idx``: the contiguous place of each row in file order.

    The place is the row's index inside its file plus the rows of the files before it; only one
    count per file is gathered, no row is moved unless the files are too many to be sent.
    """
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # over a row a file
    place = df.groupBy("__file").agg(F.count("*").alias("n")).select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    return df.join(place, "__file").withColumn("row_idx", F.col("__offset") + F.col("__row")).drop("__file", "__row", "__offset")


def in_order(splits: list[DataFrame]) -> DataFrame:
    """Splits one after the other: ``split_ord`` then ``row_idx`` is the row order."""
    parts = [s.withColumn("split_ord", F.lit(k)) for k, s in enumerate(splits)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def order_key() -> Column:
    """Split and place in one sortable number."""
    return F.col("split_ord") * F.lit(1 << 40) + F.col("row_idx")


@register_dataset("sentences")
def sentences(splits: list[DataFrame], normalize: tuple[str, ...] = ("nfc", "collapse_whitespace")) -> DataFrame:
    """Sentence classification: id is a hash of the normalised text; y the label."""
    rows = in_order(splits)
    return rows.select(T.short_hash(T.normalize(normalize, F.col("sentence"))).alias("id"), F.col("sentence").alias("x"), F.col("label").cast("string").alias("y"), F.lit("{}").alias("meta"), order_key().alias("row_idx"))


@register_dataset("choices")
def choices(rows: DataFrame) -> DataFrame:
    """Multiple choice: id is subject/place, meta holds the subject, choices and answer."""
    meta = F.to_json(F.struct(F.col("answer").alias("answer_index"), "choices", "subject"))
    return rows.select(F.concat_ws("/", "subject", F.col("row_idx").cast("string")).alias("id"), F.col("question").alias("x"), F.col("answer").cast("string").alias("y"), meta.alias("meta"), "row_idx")


@register_dataset("pairs")
def pairs(splits: list[DataFrame]) -> DataFrame:
    """Sentence pairs: rows without a known label go first, then the first row of each prompt stays."""
    known = in_order(splits).filter(F.col("label").between(0, len(RELATION) - 1)).withColumn("row_idx", order_key()).drop("split_ord")
    first = keep_first(known, ["promptID"], ["row_idx"])
    name = F.element_at(F.array(*map(F.lit, RELATION)), F.col("label").cast("int") + 1)
    meta = F.to_json(F.struct("genre", "hypothesis", name.alias("label_name"), F.col("promptID").alias("prompt_id")))
    return first.select(F.col("pairID").alias("id"), F.col("premise").alias("x"), F.col("label").cast("string").alias("y"), meta.alias("meta"), "row_idx")
