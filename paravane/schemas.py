"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

#: The parallel versions of a task, in canonical order.
VARIANTS = ("original", "paraphrase", "idiomatic")

#: A cleaned or rewritten row as it is stored: all columns are strings, meta and validators hold JSON.
VARIANT_COLUMNS = ("id", "variant", "x", "y", "meta", "augmenter_model", "prompt_hash", "validators")
VARIANT_ROW = T.StructType([T.StructField(c, T.StringType()) for c in VARIANT_COLUMNS])

TASK = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "x", "y", "meta")])

CHOICE_META = T.StructType([T.StructField("subject", T.StringType()), T.StructField("choices", T.ArrayType(T.StringType())), T.StructField("answer_index", T.IntegerType())])
PAIR_META = T.StructType([T.StructField("hypothesis", T.StringType()), T.StructField("label_name", T.StringType()), T.StructField("prompt_id", T.LongType()), T.StructField("genre", T.StringType())])
#: Everything that rendering a context may look at.
CONTEXT_META = T.StructType([T.StructField("choices", T.ArrayType(T.StringType())), T.StructField("hypothesis", T.StringType()), T.StructField("label_name", T.StringType())])

VALIDATORS = T.MapType(T.StringType(), T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))]))

OUTCOME = T.StructType([T.StructField("raw", T.StringType()), T.StructField("parsed", T.StringType()), T.StructField("parse_status", T.StringType()), T.StructField("correct", T.BooleanType())])
PER_TASK = T.StructType([T.StructField("id", T.StringType()), T.StructField("y", T.StringType()), *(T.StructField(v, OUTCOME) for v in VARIANTS)])
RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("dataset", "model_id", "model_revision", "config_hash", "prompt_hash")]
    + [T.StructField("variants_run", T.ArrayType(T.StringType())), T.StructField("per_task", T.ArrayType(PER_TASK))]
)

SKIPPED = T.StructType([T.StructField("id", T.StringType()), T.StructField("variant", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("failing", T.ArrayType(T.StringType())), T.StructField("attempts", T.IntegerType())])

#: An outcome of a rewriting session, stored before it is used: status is ok, skip or transient.
PROGRESS = T.StructType([*VARIANT_ROW.fields, T.StructField("status", T.StringType()), T.StructField("failing", T.ArrayType(T.StringType())), T.StructField("attempts", T.IntegerType()), T.StructField("cached", T.BooleanType()), T.StructField("session", T.StringType())])
