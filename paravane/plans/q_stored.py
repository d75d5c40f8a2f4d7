"""Registered queries on what is stored and called: files, caches, rewriting sessions, registries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane import config, registry
from paravane.functions import prompts
from paravane.operators import align
from paravane.operators.statistics import corrected_chi2
from paravane.plans import augment, harness, inference, sinks
from paravane.plans.analyze import KEYS
from paravane.plans.harness import CELLS_SQL, TASKS_SQL, TRIPLES_SQL, chi2_sql, rounded
from paravane.plans.q_figures import cells_of, runs
from paravane.plans.q_more import STORED_SQL, scratch, stored_rows
from paravane.schemas import VARIANT_COLUMNS, VARIANTS
from paravane.sources import results, variants
from paravane.sources.providers import EmptyResponse, TransportError

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return take


# -- files --------------------------------------------------------------------
@query(f"WITH {STORED_SQL} SELECT id, x FROM stored ORDER BY row_idx LIMIT 20")
def s5_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a variant file, in file order."""
    path = scratch(spark)
    sinks.write_rows(stored_rows(spark, sf_dir).orderBy("row_idx"), path)
    return variants.first_rows(variants.read_rows(spark, path), 20).select("id", "x")


@query(f"WITH {TRIPLES_SQL} SELECT id, o AS original, i AS idiomatic FROM triples WHERE dataset = 'alpha' AND model_id = 'model-3'")
def s8_untyped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a result document that is read without its schema."""
    outcome = F.struct("raw", "parsed", "parse_status", "correct")
    one = harness.predictions(spark, sf_dir).filter("dataset = 'alpha' AND model_id = 'model-3'").withColumn("o", outcome)
    wide = align.triples(one, ["id"], "o")
    path = scratch(spark)
    wide.agg(F.collect_list(F.struct("id", *VARIANTS)).alias("per_task")).write.json(path, ignoreNullFields=False)
    return results.read_tasks(spark, path).select("id", "original.correct", "idiomatic.correct").toDF("id", "original", "idiomatic")


@query("SELECT * FROM (VALUES (0, 'alpha/m1.json'), (1, 'alpha/m2.json'), (2, 'beta/m1.json')) t(place, file)")
def s9_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of all datasets, in lexicographic order; others are left alone."""
    path = scratch(spark)
    for name in ("beta/m1.json", "alpha/m2.json", "alpha/m1.json", "alpha/notes.txt"):
        sinks.write_text(spark, f"{path}/{name}", "{}\n")
    found = [(k, "/".join(p.rsplit("/", 2)[1:])) for k, p in enumerate(results.discover(spark, path))]
    return spark.createDataFrame(found, "place int, file string")


@query(f"WITH {CELLS_SQL}, s AS (SELECT * FROM cells WHERE dataset = 'alpha') SELECT model_id, 'idiomatic' AS variant, TTF AS count FROM s UNION ALL SELECT model_id, 'paraphrase', TFT FROM s")
def s10_published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published CSV tables of many models; the model is in the file's name."""
    path = scratch(spark)
    for r in cells_of(spark, sf_dir).filter("dataset = 'alpha'").collect():  # a row a model
        sinks.write_text(spark, f"{path}/{r['model_id']}_sole_cause.csv", f"variant,count,pct\nidiomatic,{r['TTF']},0.5\nparaphrase,{r['TFT']},0.5\n")
    return results.read_table(spark, f"{path}/*_sole_cause.csv", "variant string, count long, pct double").select("model_id", "variant", "count")


@query(f"WITH {CELLS_SQL} SELECT dataset || '-' || model_id || '.md' AS file, round({chi2_sql()}, 2) AS chi2 FROM cells")
def s11_stated_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic that Markdown reports state in their text."""
    path = scratch(spark)
    for r in cells_of(spark, sf_dir).withColumn("chi2", corrected_chi2(F.col("TTF"), F.col("TFT"))).collect():  # a row a run
        sinks.write_text(spark, f"{path}/{r['dataset']}-{r['model_id']}.md", "# Report\n\n" + f"b = {r['TTF']}, c = {r['TFT']}, χ² = {r['chi2']:.6f}, p = 0.5: a verdict.\n")
    return results.read_chi2_reports(spark, f"{path}/*.md").select("file", F.round("chi2", 2).alias("chi2"))


@query(f"WITH {STORED_SQL} SELECT id FROM stored UNION ALL SELECT 'whole'")
def s14_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A killed writer's half line is cut; every whole row stays."""
    path = scratch(spark)
    sinks.write_rows(stored_rows(spark, sf_dir), path)
    line = '{},idiomatic,"a, b",0,{{}},new,h,"{{""v"": {{""passed"": true}}}}"'
    sinks.write_text(spark, f"{path}/part-z.csv", ",".join(VARIANT_COLUMNS) + "\n" + line.format("whole") + "\n" + line.format("torn"))
    return variants.read_rows(spark, path, torn_tail=True).select("id")


@query(f"WITH {TASKS_SQL} SELECT id, 'unaligned' AS reason FROM tasks WHERE row_idx % 3 = 0")
def s15_skip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed entries of a manifest are left out."""
    path = scratch(spark)
    good = F.to_json(F.struct("id", F.lit("idiomatic").alias("variant"), F.lit("unaligned").alias("reason"), F.array().cast("array<string>").alias("failing"), F.lit(0).alias("attempts")))
    line = F.when(F.col("row_idx") % 3 == 0, good).when(F.col("row_idx") % 3 == 1, F.lit('{"id": "torn')).otherwise(F.lit('{"variant": "idiomatic"}'))
    harness.tasks(spark, sf_dir).select(line.alias("value")).write.text(path)
    return variants.read_skips(spark, path).select("id", "reason")


@query(f"WITH {TASKS_SQL} SELECT id, 'idiomatic' AS variant, 'validation_failed' AS reason, 2 AS attempts FROM tasks")
def k9_skips_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written in id order and read back."""
    path = scratch(spark)
    skips = harness.tasks(spark, sf_dir).select("id", F.lit("idiomatic").alias("variant"), F.lit("validation_failed").alias("reason"), F.array(F.lit("v")).alias("failing"), F.lit(2).alias("attempts"))
    sinks.write_skips(skips, path)
    return variants.read_skips(spark, path).select("id", "variant", "reason", "attempts")


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN row_idx % 2 = 0 THEN 'answer ' || id END AS cached, row_idx % 2 = 0 AS hit FROM tasks")
def k8_cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses appended twice, read back once a key, and looked up."""
    path = scratch(spark)
    rows = harness.tasks(spark, sf_dir).select("id", "row_idx", F.lit("h").alias("prompt_hash"), F.lit("m").alias("augmenter_model"))
    kept = rows.filter("row_idx % 2 = 0").withColumn("response", F.concat(F.lit("answer "), "id")).withColumn("validators", F.lit("{}"))
    for _ in range(2):
        sinks.append_cache(kept, path)
    sinks.append_cache(kept.withColumn("response", F.lit(None).cast("string")), path)
    return align.with_cache(rows, variants.read_cache(spark, path)).select("id", "cached", "hit")


@query("SELECT DISTINCT dataset || '/' || model_id AS run, 'r1' AS model_revision FROM (SELECT unnest(['alpha', 'beta']) AS dataset) CROSS JOIN (SELECT 'model-' || unnest(range(6)) AS model_id)")
def k7_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sinks.provenance(runs(spark))
    return spark.createDataFrame([(k, v["model_revision"]) for k, v in found.items()], "run string, model_revision string")


# -- calls --------------------------------------------------------------------
class Scripted:
    """Answers by the number in the prompt, an input of queries: every 5th row empty, every 7th one that its judge rejects."""

    down = False

    def complete(self, prompt: str, temperature: float, max_output_tokens: int) -> str:
        kind, number = prompt.split("|")[:2]
        n = int(number)
        if kind == "judge":
            return "FAIL" if n % 7 == 0 else "PASS"
        if self.down and n % 4 == 0:
            raise TransportError("not now")
        if n % 5 == 0:
            raise EmptyResponse("nothing")
        return f"{n}|rewritten"


class ScriptedDown(Scripted):
    """The same while the provider cannot be reached for every 4th row."""

    down = True


def scripted(df: DataFrame, client: type = Scripted) -> DataFrame:
    return inference.rewrite(df, client, {"label_preservation": lambda x, row: f"judge|{x}"}, max_attempts=2, backoff=0)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.tasks(spark, sf_dir).select("id", F.col("id").alias("x"), "y", F.lit("{}").alias("meta"), "row_idx")


STATUS_SQL = "CASE WHEN row_idx % 5 = 0 OR row_idx % 7 = 0 THEN 'skip' ELSE 'ok' END"


@query(f"WITH {TASKS_SQL} SELECT id, {STATUS_SQL} AS status, CASE WHEN {STATUS_SQL} = 'ok' THEN id || '|rewritten' END AS rewritten, CASE WHEN row_idx % 5 = 0 THEN 'empty_output' WHEN row_idx % 7 = 0 THEN 'label_preservation' ELSE '' END AS failing, CASE WHEN {STATUS_SQL} = 'ok' THEN 1 ELSE 2 END AS attempts FROM tasks")
def u7_rewrites_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rewrite a row, judged, tried again, and its outcome as data."""
    rows = numbered(spark, sf_dir).select("id", F.concat(F.lit("rewrite|"), "x").alias("prompt"), "x", "y", "meta", F.lit("").alias("context"))
    return scripted(rows).select("id", "status", "rewritten", F.array_join("failing", ",").alias("failing"), "attempts")


def two_sessions(spark: SparkSession, sf_dir: str) -> dict[str, augment.Build]:
    """Both variants, built in a session that the provider cuts short and in one that resumes it."""
    tasks = numbered(spark, sf_dir)
    builds = {}
    for variant in ("paraphrase", "idiomatic"):
        progress = augment.Progress(spark, scratch(spark))
        for client in (ScriptedDown, Scripted):
            builds[variant] = augment.build_variant(tasks, variant, "rewrite|{x}|" + variant, "m", lambda df, client=client: scripted(df, client), progress.kept(), progress.skipped(), None, augment.Progress(spark, progress.path).record)
    return builds


@query(f"WITH {TASKS_SQL} SELECT id, v.variant, id || '|rewritten' AS x FROM tasks CROSS JOIN (VALUES ('paraphrase'), ('idiomatic')) v(variant) WHERE {STATUS_SQL} = 'ok'")
def i6_variant_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.finish(two_sessions(spark, sf_dir))[0].select("id", "variant", "x")


@query(f"WITH {TASKS_SQL} SELECT id, 'idiomatic' AS variant, 'validation_failed' AS reason FROM tasks WHERE {STATUS_SQL} = 'skip'")
def i2_skips_after_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pause records no skip; after it was resumed only the rejected rows are listed."""
    return two_sessions(spark, sf_dir)["idiomatic"].skips.select("id", "variant", "reason")


@query(f"WITH {TASKS_SQL} SELECT id, true AS passed, 1.0::DOUBLE AS score FROM tasks")
def u5_similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.tasks(spark, sf_dir).select("id", inference.semantic_similarity().alias("s")).select("id", "s.passed", "s.score")


@query("SELECT doc_id, 'user' AS role, lang || chr(10) || chr(10) || source AS content FROM documents")
def p30_folded_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages for a template without a system role."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    folded = prompts.fold_system(F.array(one("system", "lang"), one("user", "source")))
    return harness.table(spark, sf_dir, "documents").select("doc_id", F.inline(folded)).select("doc_id", "role", "content")


# -- registries and choices ---------------------------------------------------
@query("SELECT * FROM (VALUES ('augmenter', 'anthropic'), ('augmenter', 'gemini'), ('augmenter', 'openai'), ('evaluator', 'mmlu'), ('evaluator', 'mnli'), ('evaluator', 'sst2'), ('validator', 'idiom_absence'), ('validator', 'idiom_presence'), ('validator', 'label_preservation'), ('validator', 'semantic_similarity')) t(kind, name)")
def u9_registered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (registry.AUGMENTERS, registry.EVALUATORS, registry.VALIDATORS)
    return spark.createDataFrame([(r.kind, n) for r in kinds for n in r.names()], "kind string, name string")


@query("SELECT cuda, mps, CASE WHEN cuda THEN 'cuda' WHEN mps THEN 'mps' ELSE 'cpu' END AS device, CASE WHEN cuda OR mps THEN wanted ELSE 'fp32' END AS precision, wanted FROM (VALUES (true), (false)) a(cuda) CROSS JOIN (VALUES (true), (false)) b(mps) CROSS JOIN (VALUES ('fp32'), ('fp16'), ('bf16')) c(wanted)")
def u11_device_and_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(cuda, mps, registry.pick_device(cuda, mps), wanted) for cuda in (True, False) for mps in (True, False) for wanted in ("fp32", "fp16", "bf16")]
    return spark.createDataFrame([(*r[:3], registry.pick_precision(r[2], r[3]), r[3]) for r in rows], "cuda boolean, mps boolean, device string, precision string, wanted string")


@query("SELECT * FROM (VALUES ('all on disk', 'original,idiomatic'), ('wanted', 'idiomatic'), ('unknown', NULL), ('missing', NULL)) t(asked, variants)")
def s17_variants_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def resolved(wanted):
        try:
            return ",".join(config.resolve_variants({"idiomatic", "original"}, wanted))
        except ValueError:
            return None

    asked = {"all on disk": None, "wanted": ["idiomatic"], "unknown": ["nope"], "missing": ["paraphrase"]}
    return spark.createDataFrame([(k, resolved(v)) for k, v in asked.items()], "asked string, variants string")


@query("SELECT * FROM (VALUES ('plain', true), ('unknown key', false), ('unknown check', false), ('unknown setting', false), ('unknown augmenter', false), ('missing key', false)) t(given, accepted)")
def s12_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = {"dataset": "d", "augmenter": "gemini", "augmenter_model": "m", "prompts": {"paraphrase": "p", "idiomatic": "i"}}
    given = {"plain": {}, "unknown key": {"a": 1}, "unknown check": {"validators": {"a": {}}}, "unknown setting": {"validators": {"idiom_absence": {"a": 1}}}, "unknown augmenter": {"augmenter": "a"}, "missing key": {"prompts": {}}}

    def accepted(more):
        try:
            config.AugmentConfig.of(plain | more)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k, accepted(v)) for k, v in given.items()], "given string, accepted boolean")


@query(f"WITH {CELLS_SQL} SELECT dataset, model_id, round(100.0 * TTT / n, 9) AS pct FROM cells")
def k4_sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures written as a JSON sidecar and read back."""
    path = f"{scratch(spark)}/figures.meta.json"
    rows = cells_of(spark, sf_dir).withColumn("pct", F.lit(100.0) * F.col("TTT") / F.col("n"))
    counts = {json.dumps([r["dataset"], r["model_id"]]): r["pct"] for r in rows.collect()}  # a row a run
    sinks.write_text(spark, path, sinks.json_text(sinks.sidecar("analyze", {}, counts)))
    read = spark.read.option("multiLine", True).schema("stage string, row_counts map<string, double>").json(path)
    parts = F.from_json("key", "array<string>")
    return rounded(read.filter("stage = 'analyze'").select(F.explode("row_counts").alias("key", "pct")).select(F.element_at(parts, 1).alias("dataset"), F.element_at(parts, 2).alias("model_id"), "pct"))
