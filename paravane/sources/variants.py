"""Readers of stored rows: variant CSVs, progress, skip manifests and the response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paravane import schemas
from paravane.sources import paths as P

#: RFC 4180 with line breaks inside quotes; everything is text, and an empty field is ''.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\x00", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_rows(spark: SparkSession, *paths: str, torn_tail: bool = False) -> DataFrame:
    """Variant rows with ``row_idx``, their place in file order: by path, by file name, by line.

    With ``torn_tail`` each file is cut behind its last line break first, as a killed writer may
    have left half a line; a last row that is still incomplete (its text broke off inside quotes) is
    dropped.
    """
    named = [f for p in paths for f in P.files(spark, p)]
    if torn_tail:
        for f in named:
            P.cut_torn_line(spark, f)
    schema = StructType([*schemas.VARIANT_ROW.fields, StructField("__bad", StringType())])
    reader = spark.read.options(**CSV).schema(schema).option("columnNameOfCorruptRecord", "__bad").option("mode", "PERMISSIVE")
    # a partition may hold several files in any order, but a file's rows stay in order
    order = spark.createDataFrame([(P.plain(f), k) for k, f in enumerate(named)], "__file string, __order long")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df = reader.csv(list(paths)).select("*", place.alias("__place"), F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^(\w+):/+", "$1:/").alias("__file"))
    df = df.join(F.broadcast(order), "__file")  # a row for each file
    if torn_tail:
        broken = F.col("__bad").isNotNull() | F.col("validators").isNull()
        ends = df.groupBy("__file").agg(F.max(F.struct("__place", broken.alias("broken"))).alias("e")).filter("e.broken").select("__file", F.col("e.__place").alias("__place"))
        df = df.join(F.broadcast(ends), ["__file", "__place"], "left_anti")
    return df.select(*schemas.VARIANT_COLUMNS, F.expr("shiftleft(__order, 33) + __place").alias("row_idx")).na.fill("", list(schemas.VARIANT_COLUMNS))


def first_rows(df: DataFrame, limit: int | None, path: str = "the input") -> DataFrame:
    """The first rows in file order; no row at all is an error."""
    out = df if limit is None else df.orderBy("row_idx").limit(limit)
    if out.isEmpty():
        raise ValueError(f"no rows in {path}")
    return out


def progress(df: DataFrame) -> DataFrame:
    """One row: ids done, and the model and prompt of the first row."""
    return df.agg(F.count_distinct("id").alias("done"), F.min_by("augmenter_model", "row_idx").alias("augmenter_model"), F.min_by("prompt_hash", "row_idx").alias("prompt_hash"))


def validator_results(df: DataFrame) -> DataFrame:
    """The validators column parsed: a map from name to (passed, score, details)."""
    return df.withColumn("validators", F.from_json("validators", schemas.VALIDATORS))


def read_skips(spark: SparkSession, path: str) -> DataFrame:
    """Skip manifest; what is malformed is left out, a malformed file gives no rows."""
    schema = StructType([*schemas.SKIPPED.fields, StructField("_corrupt_record", StringType())])
    lines = P.is_folder(spark, path)  # a folder holds records a line, a file one JSON array
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return df.filter("_corrupt_record IS NULL AND id IS NOT NULL AND reason IS NOT NULL").drop("_corrupt_record")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached responses with their verdicts (JSON); a record that is no JSON object counts as absent, a repeated key once."""
    df = spark.read.parquet(path)
    df = df.withColumn("response", F.get_json_object("record", "$.x")).withColumn("validators", F.get_json_object("record", "$.validators")).filter("response IS NOT NULL")
    keys = ["prompt_hash", "augmenter_model", "id"]
    return df.groupBy(*keys).agg(F.min(F.struct("response", "validators")).alias("r")).select(*keys, "r.response", "r.validators")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of earlier sessions (``schemas.PROGRESS``); none if nothing was stored yet."""
    return spark.read.schema(schemas.PROGRESS).parquet(path) if P.exists(spark, path) else spark.createDataFrame([], schemas.PROGRESS)


def row_text(rows: DataFrame) -> DataFrame:
    """Texts by (id, variant); the last row of a key wins."""
    from paravane.operators.align import last_per_id

    return last_per_id(rows.select("id", "variant", "x", "y", "meta", "row_idx"), ["id", "variant"], "row_idx").drop("row_idx")
