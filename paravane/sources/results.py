"""Readers of result files and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane import schemas
from paravane.schemas import VARIANTS
from paravane.sources.paths import exists


class MissingVariant(ValueError):
    """A result file, or a task in it, lacks a variant."""


def discover(spark: SparkSession, root: str) -> list[str]:
    """Result files root/*/*.json in lexicographic order."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/*").select("path").distinct()
    return sorted(r["path"] for r in names.collect())


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per result file, with its path."""
    return spark.read.schema(schemas.RESULT).option("multiLine", True).json(list(paths)).withColumn("path", F.col("_metadata.file_path"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of one result document, whatever else it holds and without a check; a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.option("multiLine", True).json(path).select(F.inline("per_task"))


def validated(results: DataFrame) -> DataFrame:
    """The results, or an error at run time for a file or task without all variants."""
    need = F.array(*map(F.lit, VARIANTS))
    lacking = F.array_except(need, "variants_run")
    incomplete = F.exists("per_task", lambda t: t["original"].isNull() | t["paraphrase"].isNull() | t["idiomatic"].isNull())
    guard = (
        F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("variants not run: "), F.array_join(lacking, ", "), F.lit(" in "), F.col("path"))))
        .when(incomplete, F.raise_error(F.concat(F.lit("a task lacks a variant in "), F.col("path"))))
        .otherwise(F.lit(True))
    )
    return results.filter(guard)


def predictions(results: DataFrame) -> DataFrame:
    """Long form: (dataset, model_id, id, y, variant, raw, parsed, parse_status, correct, row_idx)."""
    tasks = results.select("dataset", "model_id", F.posexplode("per_task").alias("row_idx", "t"))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"t.{v}").alias("o")) for v in VARIANTS])).alias("v")
    return tasks.select("dataset", "model_id", "row_idx", F.col("t.id").alias("id"), F.col("t.y").alias("y"), each).select("dataset", "model_id", "id", "y", "v.variant", "v.o.*", "row_idx").filter("correct IS NOT NULL")


def read_table(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Published CSV tables '{model}_{table}.csv'; the model is what the pattern's '*' stands for in the file name."""
    before, star, after = pattern.rsplit("/", 1)[-1].partition("*")
    df = spark.read.option("header", True).schema(schema).csv(pattern)
    name = F.col("_metadata.file_name")
    model = F.substring(name, F.lit(len(before) + 1), F.length(name) - len(before) - len(after)) if star else F.regexp_extract(name, r"^(.*?)_[a-z0-9]+(?:_[a-z]+)?\.csv$", 1)
    return df.withColumn("model_id", model)


def read_chi2_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """The statistic and p-value stated in Markdown reports."""
    text = spark.read.text(pattern, wholetext=True)
    number = r"([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    return text.select(
        F.col("_metadata.file_name").alias("file"),
        F.regexp_extract("value", rf"(?i)(?:chi2|chi-square|χ²)[^0-9=]*=\s*{number}", 1).try_cast("double").alias("chi2"),
        F.regexp_extract("value", rf"(?i)p(?:-value)?\s*=\s*{number}", 1).try_cast("double").alias("p_value"),
    )
