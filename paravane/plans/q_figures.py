"""Registered queries on figures: metrics, joint tables, tests, trends and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.functions import text as T
from paravane.operators import align, bootstrap, metrics, statistics
from paravane.plans import analyze, harness
from paravane.plans.analyze import KEYS
from paravane.plans.harness import ACCURACY_SQL, CELLS_SQL, PREDICTIONS_SQL, TRIPLES_SQL, cells_sql, chi2_sql, exact_sql, rounded, table
from paravane.plans.q_rows import TOKENS_SQL
from paravane.schemas import VARIANTS
from paravane.streaming.incremental import event_rates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.joint_cells(harness.predictions(spark, sf_dir))


LOST_WON = {name: tuple(" + ".join(side) for side in sides) for name, sides in metrics.DISCORDANT.items()}


@query(f"""WITH {ACCURACY_SQL} SELECT dataset, model_id, n, round(ao, 9) AS acc_original, round(ap, 9) AS acc_paraphrase, round(ai, 9) AS acc_idiomatic,
round(ap - ao, 9) AS delta_paraphrase, round(ai - ap, 9) AS delta_idiom, TTF AS b, TFT AS c, round({chi2_sql()}, 9) AS chi2 FROM acc""")
def flagship_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: accuracies, chained deltas, sole-cause counts and the corrected statistic."""
    b, c = F.col("TTF"), F.col("TFT")
    out = metrics.accuracies(cells_of(spark, sf_dir))
    return rounded(out.select(*KEYS, "n", "acc_original", "acc_paraphrase", "acc_idiomatic", "delta_paraphrase", "delta_idiom", b.alias("b"), c.alias("c"), statistics.corrected_chi2(b, c).alias("chi2")))


@query(f"""WITH {PREDICTIONS_SQL} SELECT dataset, model_id, variant, round(avg(CAST(correct AS INT)), 9) AS accuracy, round(avg(CASE WHEN parse_status = 'unparseable' THEN 1.0 ELSE 0.0 END), 9) AS unparseable_rate,
count(*) AS n, count(*) FILTER (parse_status = 'unparseable') AS n_unparseable FROM predictions GROUP BY ALL""")
def a2_variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.variant_metrics(harness.predictions(spark, sf_dir), KEYS))


@query(f"WITH {PREDICTIONS_SQL} SELECT dataset, model_id, variant, id FROM predictions WHERE parse_status = 'unparseable'")
def a2_unparseable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unparseable_ids(harness.predictions(spark, sf_dir), KEYS)


@query(f"WITH {TRIPLES_SQL} SELECT dataset, model_id, id, o AS original, p AS paraphrase, i AS idiomatic FROM triples")
def j1_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.triples(harness.predictions(spark, sf_dir), [*KEYS, "id"])


@query(f"WITH {CELLS_SQL} SELECT * FROM cells")
def a6_joint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir)


CONFUSION_ROWS = " UNION ALL ".join(f"SELECT dataset, model_id, n, {str(c[0] == 'T').lower()} AS original, {str(c[1] == 'T').lower()} AS paraphrase, {str(c[2] == 'T').lower()} AS idiomatic, {c} AS count FROM cells" for c in metrics.CELLS)


@query(f"WITH {CELLS_SQL} SELECT dataset, model_id, original, paraphrase, idiomatic, count, round(100.0 * count / n, 9) AS pct FROM ({CONFUSION_ROWS})")
def a7_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(cells_of(spark, sf_dir), KEYS))


SOLE_ROWS = " UNION ALL ".join(f"SELECT dataset, model_id, n, '{v}' AS variant, {c} AS count FROM {{0}}" for v, c in (("idiomatic_only_wrong", "TTF"), ("paraphrase_only_wrong", "TFT"), ("original_only_wrong", "FTT")))


@query(f"WITH {CELLS_SQL} SELECT dataset, model_id, variant, count, round(100.0 * count / n, 9) AS pct FROM ({SOLE_ROWS.format('cells')})")
def a8_sole_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sole_cause(cells_of(spark, sf_dir), KEYS))


POOLED_SQL = f"""{CELLS_SQL}, pooled AS (SELECT * FROM cells UNION ALL SELECT dataset, 'pooled' AS model_id, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n", *metrics.CELLS))} FROM cells GROUP BY dataset HAVING count(*) > 1)"""


@query(f"WITH {POOLED_SQL} SELECT dataset, model_id, variant, count, round(100.0 * count / n, 9) AS pct FROM ({SOLE_ROWS.format('pooled')})")
def a9_pooled_sole_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sole_cause(metrics.pooled(cells_of(spark, sf_dir), KEYS, "model_id"), KEYS))


@query(f"WITH {ACCURACY_SQL} SELECT dataset, model_id, round(ap - ao, 9) AS delta_paraphrase, round(ai - ap, 9) AS delta_idiom, round(ai - ao, 9) AS delta_naive FROM acc")
def a10_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracies(cells_of(spark, sf_dir)).select(*KEYS, "delta_paraphrase", "delta_idiom", "delta_naive"))


@query(f"""WITH {ACCURACY_SQL}, t AS (SELECT dataset, ap - ao AS dp, ai - ap AS di, ai - ao AS dn, {exact_sql(*LOST_WON['naive'])} AS p FROM acc)
SELECT dataset, count(*) AS models, round(avg(dp), 9) AS mean_delta_paraphrase, round(avg(di), 9) AS mean_delta_idiom, round(avg(dn), 9) AS mean_naive,
count(*) FILTER (p < 0.05 AND dn > 0) AS sig_pos, count(*) FILTER (p < 0.05 AND dn < 0) AS sig_neg, count(*) FILTER (dn > 0) AS positive FROM t GROUP BY dataset""")
def a11_naive_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyze.naive_contrast(cells_of(spark, sf_dir)))


def deltas_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.with_exact_p(metrics.accuracies(cells_of(spark, sf_dir)), delta_idiom_p="idiom")


@query(f"""WITH {ACCURACY_SQL}, t AS (SELECT dataset, ap - ao AS dp, ai - ap AS di, {exact_sql(*LOST_WON['idiom'])} AS p FROM acc)
SELECT dataset, count(*) AS models, round(avg(dp), 9) AS mean_delta_paraphrase, round(avg(di), 9) AS mean_delta_idiom, count(*) FILTER (p < 0.05 AND di < 0) AS sig_neg, count(*) FILTER (p < 0.05 AND di > 0) AS sig_pos FROM t GROUP BY dataset""")
def a12_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyze.dataset_summary(deltas_with_p(spark, sf_dir)))


@query(f"""WITH {TRIPLES_SQL}, kept AS (SELECT * FROM triples WHERE clean), {cells_sql('kept')},
d AS (SELECT dataset, model_id, avg(CASE WHEN clean THEN 0.0 ELSE 1.0 END) AS dropped FROM triples GROUP BY ALL),
f AS (SELECT dataset, model_id, {harness.accuracy_sql(2)} - {harness.accuracy_sql(1)} AS d_clean, {exact_sql(*LOST_WON['idiom'])} AS p_clean FROM cells)
SELECT d.dataset, d.model_id, round(dropped, 9) AS dropped, round(d_clean, 9) AS d_clean, round(p_clean, 9) AS p_clean FROM d LEFT JOIN f ON d.dataset = f.dataset AND d.model_id = f.model_id""")
def a13_parse_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyze.parse_clean_table(harness.predictions(spark, sf_dir)))


OVERLAP_SQL = f"""WITH t AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS t FROM conversations WHERE turn < 3),
w AS (SELECT a.t AS o, b.t AS p, c.t AS i, a.conv_id % 3 AS k FROM t a JOIN t b ON a.conv_id = b.conv_id JOIN t c ON a.conv_id = c.conv_id WHERE a.turn = 0 AND b.turn = 1 AND c.turn = 2)"""


def jaccard_sql(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / CAST({union} AS DOUBLE) END"


@query(f"""{OVERLAP_SQL} SELECT k, count(*) AS n, round(median({jaccard_sql('o', 'p')}), 9) AS jaccard_paraphrase, round(median({jaccard_sql('o', 'i')}), 9) AS jaccard_idiomatic, round(median({jaccard_sql('p', 'i')}), 9) AS jaccard_cross,
CAST(median(len(p) - len(o)) AS DOUBLE) AS tokens_paraphrase, CAST(median(len(i) - len(o)) AS DOUBLE) AS tokens_idiomatic, CAST(median(len(o)) AS DOUBLE) AS length_original FROM w GROUP BY k""")
def a14_arm_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("turn < 3")
    name = F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("turn").cast("int") + 1)
    long = turns.select((F.col("conv_id") % 3).alias("k"), F.col("conv_id").cast("string").alias("id"), name.alias("variant"), F.col("text").alias("x"))
    return rounded(analyze.arm_overlap(long, ["k"]))


def runs(spark: SparkSession) -> DataFrame:
    """Metadata of the harness's runs."""
    return spark.createDataFrame([(d, f"model-{m}", "r1", "c1", "p1") for d in ("alpha", "beta") for m in range(harness.MODELS)], "dataset string, model_id string, model_revision string, config_hash string, prompt_hash string")


@query()
def a15_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17 columns; the intervals are Monte Carlo, so pytest checks them."""
    found = analyze.estimates(cells_of(spark, sf_dir))
    return analyze.summary(found, runs(spark))


RUNS_SQL = "'r1' AS model_revision, 'c1' AS config_hash, 'p1' AS prompt_hash"
POINTS_SQL = f"""WITH {ACCURACY_SQL} SELECT dataset, model_id, {RUNS_SQL}, n, round(ao, 9) AS acc_original, round(ap, 9) AS acc_paraphrase, round(ai, 9) AS acc_idiomatic,
round(ap - ao, 9) AS delta_paraphrase, round({exact_sql(*LOST_WON['paraphrase'])}, 9) AS delta_paraphrase_p, round(ai - ap, 9) AS delta_idiom, round({exact_sql(*LOST_WON['idiom'])}, 9) AS delta_idiom_p FROM acc"""
POINTS = [*KEYS, "model_revision", "config_hash", "prompt_hash", "n", "acc_original", "acc_paraphrase", "acc_idiomatic", "delta_paraphrase", "delta_paraphrase_p", "delta_idiom", "delta_idiom_p"]


@query(POINTS_SQL)
def a15_summary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's columns that do not depend on drawn resamples."""
    return rounded(a15_summary(spark, sf_dir).select(*POINTS))


@query(POINTS_SQL)
def a16_cross_model_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-model table's columns that do not depend on drawn resamples."""
    return rounded(a16_cross_model(spark, sf_dir).select(*POINTS))


@query(f"""WITH {CELLS_SQL} SELECT dataset, model_id, {chi2_sql()} > 3.841458820694124 AS test_significant FROM cells""")
def a19_corrected_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected test's side of the agreement table, at 0.05."""
    return statistics.mcnemar_table(cells_of(spark, sf_dir), KEYS).select(*KEYS, (F.col("p_value") < 0.05).alias("test_significant"))


@query()
def a16_cross_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze.estimates(cells_of(spark, sf_dir))
    return analyze.cross_model(found, runs(spark))


@query()
def a17_cross_dataset_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of runs with an interval on one side of 0."""
    return analyze.significant(analyze.cross_dataset(a15_summary(spark, sf_dir)))


@query(f"WITH {ACCURACY_SQL} SELECT model_id, round(avg(ai - ap), 9) AS mean_delta_idiom FROM acc GROUP BY model_id ORDER BY 2 DESC, 1")
def a18_mean_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.accuracies(cells_of(spark, sf_dir)).groupBy("model_id").agg(F.avg("delta_idiom").alias("mean_delta_idiom"))
    return rounded(out).orderBy(F.desc("mean_delta_idiom"), "model_id")


@query()
def a19_test_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_of(spark, sf_dir)
    return analyze.test_agreement(statistics.mcnemar_table(cells, KEYS), bootstrap.difference_table(cells, KEYS))


@query(f"WITH {ACCURACY_SQL} SELECT round(min(least(ao, ap, ai)), 9) AS low, round(max(greatest(ao, ap, ai)), 9) AS high, max_by(model_id, ao * 1000 + CAST(substr(model_id, 7) AS INT)) AS best FROM acc")
def a21_axis_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = metrics.accuracies(cells_of(spark, sf_dir))
    three = ["acc_original", "acc_paraphrase", "acc_idiomatic"]
    best = F.max_by("model_id", F.col("acc_original") * 1000 + F.substring("model_id", 7, 9).cast("int"))
    return rounded(acc.agg(F.min(F.least(*three)).alias("low"), F.max(F.greatest(*three)).alias("high"), best.alias("best")))


@query(f"WITH {CELLS_SQL} SELECT dataset, model_id, n, {', '.join(f'round({exact_sql(*LOST_WON[k])}, 9) AS {k}_p' for k in ('paraphrase', 'idiom', 'naive'))} FROM cells")
def m1_exact_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.exact_table(cells_of(spark, sf_dir), KEYS))


@query(f"WITH {POOLED_SQL} SELECT dataset, model_id, TTF AS b, TFT AS c, round({chi2_sql()}, 9) AS chi2 FROM pooled")
def m2_corrected_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = metrics.pooled(cells_of(spark, sf_dir), KEYS, "model_id")
    return rounded(every.select(*KEYS, F.col("TTF").alias("b"), F.col("TFT").alias("c"), statistics.corrected_chi2(F.col("TTF"), F.col("TFT")).alias("chi2")))


@query()
def m2_chi2_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.mcnemar_table(metrics.pooled(cells_of(spark, sf_dir), KEYS, "model_id"), KEYS)


@query()
def m3_bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.difference_table(metrics.pooled(cells_of(spark, sf_dir), KEYS, "model_id"), KEYS)


@query()
def m4_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.paired_table(cells_of(spark, sf_dir), KEYS)


@query("""WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS j, length(text) AS v FROM benchmark),
d AS (SELECT b.b, CAST(('0x' || substr(md5('5|' || b.b || '|' || r.j), 1, 8)) AS BIGINT) % n.n AS pick FROM r CROSS JOIN n CROSS JOIN (SELECT unnest(range(50)) AS b) b)
SELECT CAST(d.b AS INTEGER) AS b, round(avg(r.v), 9) AS mean FROM d JOIN r ON d.pick = r.j GROUP BY d.b""")
def m3_counter_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    items = table(spark, sf_dir, "benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("j"), F.length("text").alias("v"))
    return rounded(bootstrap.counter_bootstrap(items, "v", 50, 5))


RANKS_SQL = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"


@query(f"""WITH {ACCURACY_SQL}, t AS (SELECT dataset, round(ai - ap, 9) AS d, round(ao, 9) AS a, 1 + CAST(substr(model_id, 7) AS INT) // 2 AS s FROM acc),
r AS (SELECT dataset, {RANKS_SQL.format(k='dataset', c='d')} AS rd, {RANKS_SQL.format(k='dataset', c='a')} AS ra, {RANKS_SQL.format(k='dataset', c='s')} AS rs FROM t)
SELECT dataset, count(*) AS n, round(corr(rd, ra), 9) AS rho_acc, round(corr(rd, rs), 9) AS rho_params FROM r GROUP BY dataset""")
def m5_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = rounded(metrics.accuracies(cells_of(spark, sf_dir)).select(*KEYS, "delta_idiom", "acc_original"))
    sizes = spark.createDataFrame([(f"model-{m}", float(1 + m // 2)) for m in range(harness.MODELS)], "model_id string, params double")
    return rounded(analyze.scale_trend(acc, sizes).select("dataset", "n", "rho_acc", "rho_params"))


@query(f"WITH {CELLS_SQL} SELECT dataset, model_id, CASE WHEN TTF > TFT THEN 'idiomatic' WHEN TFT > TTF THEN 'paraphrase' ELSE 'TIE' END AS verdict FROM cells")
def m8_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir).select(*KEYS, statistics.leaning(F.col("TTF"), F.col("TFT")).alias("verdict"))


@query(f"""WITH {PREDICTIONS_SQL}, m AS (SELECT dataset, variant, round(avg(CAST(correct AS INT)), 9) AS a FROM predictions GROUP BY ALL)
SELECT dataset, count(*) AS n, true AS a_agrees FROM m GROUP BY dataset""")
def j10_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = harness.predictions(spark, sf_dir).groupBy("dataset", "variant")
    one, two = per.agg(metrics.rate(F.col("correct")).alias("a")), per.agg((F.sum(F.col("correct").cast("double")) / F.count("*")).alias("b"))
    parts = [align.agreement(one.filter(F.col("dataset") == d), two, ["dataset", "variant"], {"a": "b"}).withColumn("dataset", F.lit(d)) for d in ("alpha", "beta")]
    return parts[0].unionByName(parts[1]).filter("n > 0").select("dataset", "n", "a_agrees")


@query(f"WITH {ACCURACY_SQL} SELECT model_id, {', '.join(f'round(max(CASE WHEN dataset = {q}{d}{q} THEN ai - ap END), 9) AS {d}' for q in [chr(39)] for d in ('alpha', 'beta'))} FROM acc GROUP BY model_id")
def j14_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = metrics.accuracies(cells_of(spark, sf_dir))
    return rounded(acc.groupBy("model_id").pivot("dataset", ["alpha", "beta"]).agg(F.max("delta_idiom")))


@query(f"""WITH {CELLS_SQL}, p AS (SELECT dataset, model_id, {exact_sql(*LOST_WON['idiom'])} AS p, {harness.accuracy_sql(2)} - {harness.accuracy_sql(1)} AS d FROM cells)
SELECT dataset, model_id, CASE WHEN p < 0.0001 THEN '<0.0001' ELSE printf('%.4f', p) END AS p_text, printf('%+.2f', 100.0 * d) AS points FROM p""")
def p23_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas_with_p(spark, sf_dir).select(*KEYS, T.p_text(F.col("delta_idiom_p")).alias("p_text"), T.signed_points(F.col("delta_idiom")).alias("points"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""")
def i7_event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_rates(table(spark, sf_dir, "events")), 6)


@query("""WITH v AS (SELECT doc_id, n.name, (doc_id + n.k) % 3 <> 0 AS passed FROM documents CROSS JOIN (VALUES (0, 'label_preservation'), (1, 'idiom_presence')) n(k, name))
SELECT 'idiomatic' AS variant, name, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM v GROUP BY name""")
def a5_validator_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paravane.sources.variants import validator_results

    def one(name: str, k: int):
        return F.struct(((F.col("doc_id") + k) % 3 != 0).alias("passed"), F.lit(1.0).alias("score"))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(one("l", 0).alias("label_preservation"), one("p", 1).alias("idiom_presence"))).alias("validators"))
    return metrics.validator_tally(validator_results(docs).withColumn("variant", F.lit("idiomatic")), ["variant"])
