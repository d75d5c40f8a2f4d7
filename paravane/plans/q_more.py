"""Registered queries on stored rows, resuming, lookups, displays and small statistics."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paravane.functions import parsers, prompts, special
from paravane.functions import text as T
from paravane.operators import align, metrics, statistics
from paravane.plans import analyze, evaluate, harness, inference, sinks
from paravane.plans.analyze import KEYS
from paravane.plans.harness import ACCURACY_SQL, CELLS_SQL, PREDICTIONS_SQL, TASKS_SQL, TRIPLES_SQL, exact_sql, rounded, table
from paravane.plans.q_figures import LOST_WON, RANKS_SQL, cells_of, deltas_with_p
from paravane.plans.q_rows import ROWS_SQL, variant_rows
from paravane.registry import DISPLAY, PARAMETERS
from paravane.schemas import VARIANTS
from paravane.sources import results, tasks, variants

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only a local session may go without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="paravane-")
    return f"{root}/rows-{uuid.uuid4().hex}"


# -- stored rows --------------------------------------------------------------
STORED_SQL = f"""{TASKS_SQL}, stored AS (SELECT id, 'idiomatic' AS variant, x, y, '{{}}' AS meta, CASE WHEN row_idx % 4 = 0 THEN 'old' ELSE 'new' END AS augmenter_model, 'h' AS prompt_hash,
'{{"idiom_presence":{{"passed":' || CASE WHEN row_idx % 3 = 0 THEN 'false' ELSE 'true' END || ',"score":1.0,"details":{{}}}}}}' AS validators, row_idx FROM tasks)"""


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct((F.col("row_idx") % 3 != 0).alias("passed"), F.lit(1.0).alias("score"), F.create_map().cast("map<string,string>").alias("details"))
    rows = harness.tasks(spark, sf_dir).select("id", F.lit("idiomatic").alias("variant"), "x", "y", F.lit("{}").alias("meta"), F.when(F.col("row_idx") % 4 == 0, "old").otherwise("new").alias("augmenter_model"), F.lit("h").alias("prompt_hash"), F.create_map(F.lit("idiom_presence"), one).alias("validators"), "row_idx")
    return sinks.with_validators_json(rows)


def written_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as a variant CSV and read back."""
    path = scratch(spark)
    sinks.write_rows(stored_rows(spark, sf_dir), path)
    return variants.read_rows(spark, path)


@query(f"WITH {STORED_SQL} SELECT id, variant, x, y, meta, augmenter_model, prompt_hash, validators FROM stored")
def s4_variant_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV sink and source: what was written is read back byte by byte."""
    return written_rows(spark, sf_dir).drop("row_idx")


@query(f"WITH {STORED_SQL} SELECT count(DISTINCT id) AS done, min_by(augmenter_model, row_idx) AS augmenter_model, min_by(prompt_hash, row_idx) AS prompt_hash FROM stored")
def s13_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.progress(stored_rows(spark, sf_dir))


@query(f"WITH {STORED_SQL} SELECT 'idiom_presence' AS name, count(*) FILTER (row_idx % 3 <> 0) AS passed, count(*) FILTER (row_idx % 3 = 0) AS failed FROM stored")
def s13_validator_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.validator_tally(variants.validator_results(written_rows(spark, sf_dir)), [])


@query(f"WITH {STORED_SQL} SELECT id FROM stored WHERE augmenter_model = 'new' AND prompt_hash = 'h'")
def i1_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.resumable(stored_rows(spark, sf_dir), "new", "h").select("id")


@query(f"WITH {STORED_SQL} SELECT id, row_idx % 3 <> 0 AS passed FROM stored")
def u6_validator_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = variants.validator_results(stored_rows(spark, sf_dir))
    both = parsed.withColumn("validators", F.map_concat("validators", F.create_map(F.lit("semantic_similarity"), inference.semantic_similarity())))
    return both.select("id", inference.chain_passed().alias("passed"))


@query(f"WITH {PREDICTIONS_SQL} SELECT dataset, model_id, id, y, variant, raw, parsed, parse_status, correct FROM predictions")
def s7_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written as JSON, read, validated and exploded."""
    outcome = F.struct("raw", "parsed", "parse_status", "correct")
    long = harness.predictions(spark, sf_dir).withColumn("o", outcome)
    wide = align.triples(long, [*KEYS, "id", "y"], "o")
    files = wide.groupBy(*KEYS).agg(F.collect_list(F.struct("id", "y", *VARIANTS)).alias("per_task")).withColumn("variants_run", F.array(*map(F.lit, VARIANTS)))
    path = scratch(spark)
    files.repartition(*KEYS).write.json(path, ignoreNullFields=False)
    read = spark.read.schema(results.schemas.RESULT).json(path).withColumn("path", F.lit("result"))
    return results.predictions(results.validated(read)).drop("row_idx")


@query("SELECT text, 0 AS split_ord, doc_id AS row_idx FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT text, 1, doc_id FROM documents WHERE doc_id % 2 = 1")
def t1_union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("row_idx"))
    return tasks.in_order([rows.filter("row_idx % 2 = 0"), rows.filter("row_idx % 2 = 1")]).select("text", "split_ord", "row_idx")


@query("SELECT conv_id, len(list_filter(['user', 'assistant'], lambda r: NOT list_contains(list(DISTINCT role), r))) = 0 AS complete FROM conversations GROUP BY conv_id")
def t6_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return roles.select("conv_id", (F.size(F.array_except(F.array(F.lit("user"), F.lit("assistant")), "r")) == 0).alias("complete"))


# -- text and display ---------------------------------------------------------
@query("SELECT doc_id, CAST(to_json(struct_pack(lang := lang, source := source)) AS VARCHAR) AS key FROM documents")
def p5_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("m", F.struct("source", "lang"))
    return docs.select("doc_id", T.canonical_json(F.col("m"), ["source", "lang"]).alias("key"))


@query(f"""SELECT substr(sha256('{prompts.SENTIMENT_SYSTEM.replace("'", "''")}' || chr(30) || 'Sentence: {{x}}' || chr(10) || 'Answer:'), 1, 16) AS prompt_hash""")
def p7_prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(evaluate.SENTIMENT.prompt_hash().alias("prompt_hash"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plan</think>' || source || '</think>' || lang ELSE source END AS raw FROM documents)
SELECT doc_id, CASE WHEN contains(raw, '</think>') THEN substr(raw, instr(raw, '</think>') + 8) ELSE raw END AS answer FROM r""")
def p13_strip_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("plan</think>"), "source", F.lit("</think>"), "lang")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", parsers.strip_reasoning(raw).alias("answer"))


NAMES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}', {PARAMETERS[k]})" for k, v in DISPLAY.items()) + ") names(model_id, shown, params)"
IDS_SQL = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unlisted' ELSE list_extract({list(DISPLAY)}, CAST(doc_id % {len(DISPLAY)} AS INT) + 1) END AS model_id FROM documents"


def model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.element_at(F.array(*map(F.lit, DISPLAY)), (F.col("doc_id") % len(DISPLAY)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "unlisted").otherwise(listed).alias("model_id"))


def panel(spark: SparkSession) -> DataFrame:
    """The panel as a dimension: one row per model."""
    return spark.createDataFrame([(k, v, PARAMETERS[k]) for k, v in DISPLAY.items()], "model_id string, shown string, params double")


@query(f"SELECT doc_id, coalesce(shown, i.model_id) AS shown FROM ({IDS_SQL}) i LEFT JOIN {NAMES_SQL} ON i.model_id = names.model_id")
def p24_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_ids(spark, sf_dir).join(F.broadcast(panel(spark)), "model_id", "left").select("doc_id", F.coalesce("shown", "model_id").alias("shown"))


@query(f"SELECT model_id, count(*) AS n FROM ({IDS_SQL}) WHERE model_id <> 'unlisted' GROUP BY model_id")
def p25_panel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_ids(spark, sf_dir).join(F.broadcast(panel(spark)), "model_id", "left_semi").groupBy("model_id").count().withColumnRenamed("count", "n")


@query(f"WITH {TRIPLES_SQL} SELECT dataset, model_id, id, clean FROM triples")
def p26_parse_clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.parse_clean(harness.predictions(spark, sf_dir), [*KEYS, "id"]).select(*KEYS, "id", "clean")


BOUNDS_SQL = f"{ACCURACY_SQL}, bounds AS (SELECT dataset, model_id, ai - ap AS d, ai - ap - 0.03 AS lo, ai - ap + 0.02 AS hi FROM acc)"


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("delta_idiom")
    return metrics.accuracies(cells_of(spark, sf_dir)).select(*KEYS, d.alias("d"), (d - 0.03).alias("lo"), (d + 0.02).alias("hi"))


@query(f"WITH {BOUNDS_SQL} SELECT dataset, model_id FROM bounds WHERE lo > 0 OR hi < 0")
def p27_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir).filter(statistics.resolved("lo", "hi")).select(*KEYS)


@query(f"WITH {BOUNDS_SQL} SELECT dataset, model_id, round(hi - d, 9) AS d_plus, round(d - lo, 9) AS d_minus FROM bounds")
def p28_error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bounds(spark, sf_dir).select(*KEYS, *statistics.error_bars("d", "lo", "hi")))


@query("SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 100.0 * (doc_id % 3) / (doc_id % 5) END, 9) AS pct FROM documents")
def p29_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rounded(docs.select("doc_id", T.percent(F.col("doc_id") % 3, F.col("doc_id") % 5).alias("pct")))


# -- joins --------------------------------------------------------------------
@query(f"""WITH {ROWS_SQL}, c AS (SELECT id, variant, CAST(id AS BIGINT) % 4 <> 0 AS correct FROM rows)
SELECT id, bool_or(correct) FILTER (variant = 'original') AS original, bool_or(correct) FILTER (variant = 'paraphrase') AS paraphrase, bool_or(correct) FILTER (variant = 'idiomatic') AS idiomatic FROM c GROUP BY id HAVING count(DISTINCT variant) = 3""")
def j3_aligned_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that lack a variant are dropped."""
    rows = variant_rows(spark, sf_dir).withColumn("correct", F.col("id").cast("long") % 4 != 0)
    return align.triples(rows, ["id"])


@query(f"""WITH {TRIPLES_SQL} SELECT t.id, t.o AS orig_correct, t.p AS para_correct, t.i AS idiom_correct, coalesce(x.x, '') AS x FROM triples t LEFT JOIN (SELECT * FROM tasks WHERE row_idx % 2 = 0) x ON t.id = x.id WHERE t.model_id = 'model-1'""")
def j4_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned correctness with the original's text, '' where there is none."""
    aligned = align.triples(harness.predictions(spark, sf_dir).filter("model_id = 'model-1'"), ["id"])
    texts = harness.tasks(spark, sf_dir).filter("row_idx % 2 = 0").select("id", "x")
    return aligned.join(texts, "id", "left").select("id", F.col("original").alias("orig_correct"), F.col("paraphrase").alias("para_correct"), F.col("idiomatic").alias("idiom_correct"), F.coalesce("x", F.lit("")).alias("x"))


@query("""SELECT a.conv_id, length(a.text) AS a, length(b.text) AS b, length(c.text) AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id JOIN conversations c ON a.conv_id = c.conv_id WHERE a.turn = 0 AND b.turn = 1 AND c.turn = 2""")
def j11_three_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle instead of two joins: the pivot aligns the three frames."""
    turns = table(spark, sf_dir, "conversations").filter("turn < 3")
    name = F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("turn").cast("int") + 1)
    wide = align.triples(turns.select("conv_id", name.alias("variant"), F.length("text").cast("long").alias("n")), ["conv_id"], "n")
    return wide.toDF("conv_id", "a", "b", "c")


@query(f"WITH {CELLS_SQL} SELECT a.dataset, a.model_id, a.TTF AS b, a.TFT AS c FROM cells a JOIN (SELECT DISTINCT dataset, model_id FROM cells WHERE model_id <> 'model-2') x ON a.dataset = x.dataset AND a.model_id = x.model_id")
def j13_sole_and_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that lack one of the two tables are skipped."""
    cells = cells_of(spark, sf_dir)
    return cells.select(*KEYS, F.col("TTF").alias("b"), F.col("TFT").alias("c")).join(cells.filter("model_id <> 'model-2'").select(*KEYS), KEYS)


# -- inference, resuming, replay ----------------------------------------------
def stub_model():
    """Answers by the length of the prompt: an input of tests and queries, not a model."""
    return lambda chats: ["positive" if len(c[-1]["content"]) % 2 else "negative" for c in chats]


STUB_SQL = "CASE WHEN length('Sentence: ' || lang || source || chr(10) || 'Answer:') % 2 = 1 THEN 'positive' ELSE 'negative' END"


def short_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.tasks(spark, sf_dir).select("id", F.lit("original").alias("variant"), F.concat("lang", "source").alias("x"), "y", F.lit("{}").alias("meta"), "row_idx")


@query(f"WITH {TASKS_SQL}, r AS (SELECT id, y, {STUB_SQL} AS raw FROM tasks) SELECT id, raw, CASE raw WHEN 'positive' THEN '1' ELSE '0' END AS parsed, CASE raw WHEN 'positive' THEN '1' ELSE '0' END = y AS correct FROM r")
def u1_batched_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = evaluate.evaluate(short_tasks(spark, sf_dir), evaluate.SENTIMENT, lambda df: inference.predict(df, stub_model))
    return done.select("id", "raw", "parsed", "correct")


@query(f"WITH {TASKS_SQL}, r AS (SELECT id, y, CASE WHEN row_idx % 2 = 0 THEN 'kept' ELSE {STUB_SQL} END AS raw FROM tasks) SELECT id, raw FROM r")
def i4_checkpointed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a checkpoint holds are not sent again."""
    rows = short_tasks(spark, sf_dir)
    done = evaluate.SENTIMENT.scored(rows.filter("row_idx % 2 = 0").withColumn("raw", F.lit("kept")))
    return evaluate.evaluate(rows, evaluate.SENTIMENT, lambda df: inference.predict(df, stub_model), done).select("id", "raw")


@query(f"""WITH {PREDICTIONS_SQL} SELECT round(avg(CAST(correct AS INT)), 9) AS accuracy, round(avg(CASE WHEN parse_status = 'unparseable' THEN 1.0 ELSE 0.0 END), 9) AS unparseable_rate, count(*) AS n, count(*) FILTER (parse_status = 'unparseable') AS n_unparseable
FROM predictions WHERE model_id = 'model-3' AND variant = 'idiomatic'""")
def i5_replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = harness.outputs(spark, sf_dir).filter("model_id = 'model-3' AND variant = 'idiomatic'").select("id", "raw")
    rows = harness.tasks(spark, sf_dir).select("id", F.lit("idiomatic").alias("variant"), "y", "row_idx")
    return rounded(evaluate.run_metrics(evaluate.replay(rows, stored, evaluate.SENTIMENT)).drop("variant"))


# -- small statistics ---------------------------------------------------------
@query(f"WITH {ACCURACY_SQL} SELECT dataset, model_id, round(ao, 9) AS acc_original, row_number() OVER (PARTITION BY dataset ORDER BY ao, model_id) AS place FROM acc")
def w4_plot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = metrics.accuracies(cells_of(spark, sf_dir)).select(*KEYS, "acc_original")
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("acc_original", "model_id")).cast("long")
    return rounded(acc.withColumn("place", place))


@query(f"SELECT bool_and(params >= coalesce(before, params)) AS ascending, max(params) / min(params) AS fold FROM (SELECT params, lag(params) OVER (ORDER BY place) AS before FROM (SELECT params, row_number() OVER () AS place FROM {NAMES_SQL}))")
def w7_ascending_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(PARAMETERS.values())], "place long, params double")
    before = F.lag("params").over(Window.orderBy("place"))  # one row per model
    return rows.withColumn("before", before).agg(F.bool_and(F.col("params") >= F.coalesce("before", "params")).alias("ascending"), (F.max("params") / F.min("params")).alias("fold"))


@query(f"""WITH {ACCURACY_SQL}, t AS (SELECT dataset, round(ai - ap, 9) AS d, round(ao, 9) AS a, 1 + CAST(substr(model_id, 7) AS INT) // 2 AS s FROM acc),
r AS (SELECT dataset, {RANKS_SQL.format(k='dataset', c='d')} AS rd, {RANKS_SQL.format(k='dataset', c='a')} AS ra, {RANKS_SQL.format(k='dataset', c='s')} AS rs FROM t),
c AS (SELECT dataset, corr(rd, ra) AS ca, corr(rd, rs) AS cs FROM r GROUP BY dataset),
l AS (SELECT round(abs(ca), 9) AS abs_rho, dataset, 'accuracy' AS label FROM c UNION ALL SELECT round(abs(cs), 9), dataset, 'params' FROM c)
SELECT abs_rho, dataset, label FROM l ORDER BY abs_rho DESC, dataset DESC, label DESC LIMIT 1""")
def a20_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = rounded(metrics.accuracies(cells_of(spark, sf_dir)).select(*KEYS, "delta_idiom", "acc_original"))
    sizes = spark.createDataFrame([(f"model-{m}", float(1 + m // 2)) for m in range(harness.MODELS)], "model_id string, params double")
    return rounded(analyze.strongest(rounded(analyze.scale_trend(acc, sizes))))


@query(f"""WITH {ACCURACY_SQL}, s AS (SELECT dataset, model_id, {exact_sql(*LOST_WON['idiom'])} AS p, ai - ap - 0.03 AS lo, ai - ap + 0.02 AS hi FROM acc)
SELECT dataset, model_id, p < 0.05 AS test_significant, lo > 0 OR hi < 0 AS interval_significant, (p < 0.05) = (lo > 0 OR hi < 0) AS agree FROM s""")
def m9_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = deltas_with_p(spark, sf_dir).withColumn("lo", F.col("delta_idiom") - 0.03).withColumn("hi", F.col("delta_idiom") + 0.02)
    return both.select(*KEYS, *statistics.significance(F.col("delta_idiom_p"), F.col("lo"), F.col("hi")))


@query("""SELECT CAST(k AS BIGINT) AS k, round(list_sum(list_transform(range(k, 15), lambda i: exp(lgamma(15.0) - lgamma(i + 1.0) - lgamma(15.0 - i) + i * ln(0.05) + (14 - i) * ln(0.95)))), 12) AS tail FROM (SELECT unnest(range(0, 15)) AS k)""")
def m7_binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(X >= k) of 14 tests at 0.05."""
    return spark.createDataFrame(pd.DataFrame({"k": range(15), "tail": [round(special.binomial_tail(k, 14, 0.05), 12) for k in range(15)]}))


@query()
def m6_detection_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest rank correlation that a test at this n can call significant."""
    return spark.createDataFrame([(n, special.least_detectable_rho(n, 0.05)) for n in (6, 14, 42)], "n int, rho double")


@query()
def m5_trend_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = metrics.accuracies(cells_of(spark, sf_dir))
    sizes = spark.createDataFrame([(f"model-{m}", float(1 + m // 2)) for m in range(harness.MODELS)], "model_id string, params double")
    return analyze.scale_trend(acc, sizes)


@query("SELECT event_type, count(*) AS sessions, round(sum(value), 4) AS wall_time FROM events GROUP BY event_type")
def a22_wall_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time over sessions: a sum of one metric row per session."""
    sessions = table(spark, sf_dir, "events").groupBy("event_type")
    return rounded(sessions.agg(F.count("*").alias("sessions"), F.sum("value").alias("wall_time")), 4)
