"""Inputs of the registered queries, derived from the driver's tables in Spark and in SQL alike.

No model output is available, so ``raw`` texts are derived from a hash of
(id, model, variant): harness inputs, not results of any model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.plans.evaluate import SENTIMENT
from paravane.schemas import VARIANTS

MODELS = 6

#: White space as a RE2 class, as ``functions.text.WHITE_SPACE`` is for Java.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
COLLAPSED = f"trim(regexp_replace(nfc_normalize(text), '{SPACE}', ' ', 'g'))"

TASKS_SQL = """tasks AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN d.lang = 'en' THEN 'alpha' ELSE 'beta' END AS dataset,
         d.text AS x, CAST(l.quality AS VARCHAR) AS y, d.lang, d.source, d.doc_id AS row_idx
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

RAW_SQL = f"""{TASKS_SQL}, arms AS (
  SELECT t.*, m.m, 'model-' || m.m AS model_id, v.v, v.variant,
         CAST(('0x' || substr(md5(t.id || '|' || 'model-' || m.m || '|' || v.variant), 1, 6)) AS BIGINT) % 100 AS h
  FROM tasks t CROSS JOIN (SELECT unnest(range({MODELS})) AS m) m
  CROSS JOIN (VALUES (0, 'original'), (1, 'paraphrase'), (2, 'idiomatic')) v(v, variant)),
said AS (SELECT *, CASE WHEN (y = '1') = (h < 55 + 4 * m - 3 * v) THEN 'positive' ELSE 'negative' END AS word FROM arms),
outputs AS (SELECT *, CASE WHEN h >= 96 THEN 'n/a'
  WHEN h % 4 = 0 THEN '<think>positive or negative?</think> ' || word
  WHEN h % 4 = 1 THEN upper(word) || '.'
  WHEN h % 4 = 2 THEN 'The answer is ' || word || ', not the other one'
  ELSE word END AS raw FROM said)"""

PREDICTIONS_SQL = f"""{RAW_SQL}, final AS (SELECT *, lower(CASE WHEN contains(raw, '</think>') THEN substr(raw, instr(raw, '</think>') + 8) ELSE raw END) AS answer FROM outputs),
places AS (SELECT *, instr(answer, 'positive') AS p, instr(answer, 'negative') AS q FROM final),
parsed AS (SELECT *, CASE WHEN p > 0 AND (q = 0 OR p < q) THEN '1' WHEN q > 0 THEN '0' END AS parsed FROM places),
predictions AS (SELECT dataset, model_id, id, variant, y, raw, parsed, CASE WHEN parsed IS NULL THEN 'unparseable' ELSE 'ok' END AS parse_status, coalesce(parsed = y, false) AS correct, row_idx FROM parsed)"""

TRIPLES_SQL = f"""{PREDICTIONS_SQL}, triples AS (
  SELECT dataset, model_id, id, bool_or(correct) FILTER (variant = 'original') AS o, bool_or(correct) FILTER (variant = 'paraphrase') AS p,
         bool_or(correct) FILTER (variant = 'idiomatic') AS i, bool_and(parse_status = 'ok') AS clean
  FROM predictions GROUP BY ALL HAVING count(DISTINCT variant) = 3)"""


def cells_sql(source: str = "triples", name: str = "cells", keys: str = "dataset, model_id") -> str:
    def part(c: str) -> str:
        return f"count(*) FILTER ({' AND '.join(v if f == 'T' else f'NOT {v}' for v, f in zip('opi', c))}) AS {c}"

    names = [f"{a}{b}{c}" for a in "TF" for b in "TF" for c in "TF"]
    return f"{name} AS (SELECT {keys}, count(*) AS n, {', '.join(map(part, names))} FROM {source} GROUP BY ALL)"


CELLS_SQL = f"{TRIPLES_SQL}, {cells_sql()}"


def accuracy_sql(place: int) -> str:
    return "(" + " + ".join(f"{a}{b}{c}" for a in "TF" for b in "TF" for c in "TF" if (a + b + c)[place] == "T") + ") / CAST(n AS DOUBLE)"


ACCURACY_SQL = f"{CELLS_SQL}, acc AS (SELECT *, {accuracy_sql(0)} AS ao, {accuracy_sql(1)} AS ap, {accuracy_sql(2)} AS ai FROM cells)"


def exact_sql(lost: str, won: str) -> str:
    """Two-sided exact p-value in SQL, from log-gamma."""
    n, k = f"(({lost}) + ({won}))", f"least({lost}, {won})"
    tail = f"list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda j: exp(lgamma({n} + 1.0) - lgamma(j + 1.0) - lgamma({n} - j + 1.0) - {n} * ln(2.0))))"
    return f"CASE WHEN ({lost}) = ({won}) THEN 1.0 ELSE least(1.0, 2.0 * {tail}) END"


def chi2_sql(b: str = "TTF", c: str = "TFT") -> str:
    return f"CASE WHEN {b} + {c} = 0 THEN 0.0 ELSE pow(abs({b} - {c}) - 1.0, 2) / ({b} + {c}) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dataset, x, y, lang, source, row_idx): labelled documents as classification tasks."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "alpha").otherwise("beta").alias("dataset"), F.col("text").alias("x"), F.col("quality").cast("string").alias("y"), "lang", "source", F.col("doc_id").alias("row_idx")
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs of MODELS models on three variants of each task; texts stay behind."""
    arms = tasks(spark, sf_dir).drop("x").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1)))).withColumn("model_id", F.concat(F.lit("model-"), F.col("m").cast("string")))
    arms = arms.select("*", F.posexplode(F.array(*map(F.lit, VARIANTS))).alias("v", "variant"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "id", "model_id", "variant")), 1, 6), 16, 10).cast("long") % 100
    said = arms.withColumn("h", h).withColumn("word", F.when((F.col("y") == "1") == (F.col("h") < 55 + 4 * F.col("m") - 3 * F.col("v")), "positive").otherwise("negative"))
    raw = (
        F.when(F.col("h") >= 96, "n/a")
        .when(F.col("h") % 4 == 0, F.concat(F.lit("<think>positive or negative?</think> "), "word"))
        .when(F.col("h") % 4 == 1, F.concat(F.upper("word"), F.lit(".")))
        .when(F.col("h") % 4 == 2, F.concat(F.lit("The answer is "), "word", F.lit(", not the other one")))
        .otherwise(F.col("word"))
    )
    return said.withColumn("raw", raw).drop("h", "word", "m", "v")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = SENTIMENT.scored(outputs(spark, sf_dir))
    return scored.select("dataset", "model_id", "id", "variant", "y", "raw", "parsed", "parse_status", "correct", "row_idx")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare equal."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})

