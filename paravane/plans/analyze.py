"""Analysis: the summary, cross-model, cross-dataset, confusion and trend tables.

All of them derive from the joint cells, so the predictions are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paravane.functions.special import binomial_tail, least_detectable_rho
from paravane.operators import align, bootstrap, metrics, statistics

KEYS = ["dataset", "model_id"]
ESTIMATE = ["{0}", "{0}_ci_low", "{0}_ci_high", "{0}_p"]
DELTAS = [c.format(d) for d in ("delta_paraphrase", "delta_idiom") for c in ESTIMATE]
SUMMARY = [*KEYS, "model_revision", "config_hash", "prompt_hash", "n", "acc_original", "acc_paraphrase", "acc_idiomatic", *DELTAS]


def joint_cells(predictions: DataFrame, strict: bool = False) -> DataFrame:
    """Cells by (dataset, model); strict makes an incomplete triple an error instead of dropping it."""
    wide = (align.require_triples if strict else align.triples)(predictions, [*KEYS, "id"])
    return metrics.cells(wide, KEYS)


def estimates(cells: DataFrame, resamples: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Points, intervals and exact p-values of each run: the cross-model table without run metadata."""
    tested = statistics.with_exact_p(cells, delta_paraphrase_p="paraphrase", delta_idiom_p="idiom")
    return bootstrap.paired_table(tested, [*KEYS, "delta_paraphrase_p", "delta_idiom_p"], resamples, level, seed)


def summary(estimates_: DataFrame, runs: DataFrame) -> DataFrame:
    """The 17-column summary: run metadata, accuracies, deltas with intervals and p-values."""
    return runs.join(estimates_, KEYS).select(*SUMMARY)


def cross_model(estimates_: DataFrame, runs: DataFrame) -> DataFrame:
    """The 23-column table: the summary with intervals of the accuracies, in plotting order."""
    more = [f"acc_{v}_ci_{end}" for v in ("original", "paraphrase", "idiomatic") for end in ("low", "high")]
    return runs.join(estimates_, KEYS).select(*SUMMARY, *more).orderBy("dataset", "acc_original", "model_id")


def cross_dataset(summary_: DataFrame) -> DataFrame:
    """Deltas only: 10 columns."""
    return summary_.select(*KEYS, *DELTAS)


def significant(table: DataFrame) -> DataFrame:
    """Runs with an interval that lies on one side of 0 for either delta."""
    return table.filter(statistics.resolved("delta_paraphrase_ci_low", "delta_paraphrase_ci_high") | statistics.resolved("delta_idiom_ci_low", "delta_idiom_ci_high"))


def dataset_summary(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean deltas and counts of significant idiom deltas by dataset."""
    hit = F.col("delta_idiom_p") < alpha
    return table.groupBy("dataset").agg(
        F.count("*").alias("models"),
        F.avg("delta_paraphrase").alias("mean_delta_paraphrase"),
        F.avg("delta_idiom").alias("mean_delta_idiom"),
        F.count_if(hit & (F.col("delta_idiom") < 0)).alias("sig_neg"),
        F.count_if(hit & (F.col("delta_idiom") > 0)).alias("sig_pos"),
    )


def naive_contrast(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The contrast a study without the control would report, with its decomposition, by dataset."""
    each = statistics.with_exact_p(metrics.accuracies(cells), naive_p="naive")
    hit = F.col("naive_p") < alpha
    return each.groupBy("dataset").agg(
        F.count("*").alias("models"),
        F.avg("delta_paraphrase").alias("mean_delta_paraphrase"),
        F.avg("delta_idiom").alias("mean_delta_idiom"),
        F.avg("delta_naive").alias("mean_naive"),
        F.count_if(hit & (F.col("delta_naive") > 0)).alias("sig_pos"),
        F.count_if(hit & (F.col("delta_naive") < 0)).alias("sig_neg"),
        F.count_if(F.col("delta_naive") > 0).alias("positive"),
    )


def parse_clean_table(predictions: DataFrame) -> DataFrame:
    """Share dropped, idiom delta and exact p over triples whose outputs were all parsed; null delta if none is left."""
    wide = metrics.parse_clean(predictions, [*KEYS, "id"])
    # one pass: the cells count clean triples only, `total` counts all
    kept = wide.select(*KEYS, "clean", *[F.when(F.col("clean"), F.col(v)).alias(v) for v in ("original", "paraphrase", "idiomatic")])
    counted = metrics.cells(kept, KEYS, total="total", where=F.col("clean"))
    figures = statistics.with_exact_p(metrics.accuracies(counted), p_clean="idiom")
    some = lambda c: F.when(F.col("n") > 0, F.col(c))
    return figures.select(*KEYS, ((F.col("total") - F.col("n")) / F.col("total")).alias("dropped"), some("delta_idiom").alias("d_clean"), some("p_clean").alias("p_clean"))


def scale_trend(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Spearman correlations of the idiom delta with original accuracy and with model size, by dataset.

    ``sizes`` is a dimension with one row per model.
    """
    joined = table.join(F.broadcast(sizes), "model_id")  # one row per model of the panel
    accuracy = statistics.with_spearman_p(statistics.spearman(joined, ["dataset"], "delta_idiom", "acc_original"))
    size = statistics.with_spearman_p(statistics.spearman(joined, ["dataset"], "delta_idiom", "params"))
    return accuracy.select("dataset", "n", F.col("rho").alias("rho_acc"), F.col("p_value").alias("p_acc")).join(size.select("dataset", F.col("rho").alias("rho_params"), F.col("p_value").alias("p_params")), "dataset")


def strongest(trend: DataFrame) -> DataFrame:
    """The largest |rho| with its dataset and label."""
    each = trend.select("dataset", F.expr("stack(2, 'params', rho_params, 'accuracy', rho_acc) as (label, rho)"))
    return each.agg(F.max(F.struct(F.abs("rho").alias("abs_rho"), "dataset", "label")).alias("m")).select("m.*")


def multiplicity(counts: dict[str, int], n: int, alpha: float = 0.05) -> dict[str, float]:
    """How surprising each count of significant models is under a true null."""
    return {name: binomial_tail(k, n, alpha) for name, k in counts.items() if k}


def detection_floor(n: int, alpha: float = 0.05) -> float:
    return least_detectable_rho(n, alpha)


def test_agreement(tests: DataFrame, intervals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Runs on which the corrected test and the bootstrap disagree."""
    both = tests.join(intervals.select(*KEYS, F.col("p_value").alias("p_boot")), KEYS)
    differ = (F.col("p_value") < alpha) != (F.col("p_boot") < alpha)
    return both.agg(F.count("*").alias("runs"), F.count_if(differ).alias("disagreements"))


def arm_overlap(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Median token Jaccard of each rewrite with the original and with each other, token deltas and lengths.

    ``texts`` is long: (keys..., id, variant, x).
    """
    from paravane.functions import text as T

    wide = align.triples(texts.withColumn("tokens", T.tokens(F.col("x"))), [*keys, "id"], "tokens")
    o, p, i = F.col("original"), F.col("paraphrase"), F.col("idiomatic")
    return wide.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.median(T.token_jaccard(o, p)).alias("jaccard_paraphrase"),
        F.median(T.token_jaccard(o, i)).alias("jaccard_idiomatic"),
        F.median(T.token_jaccard(p, i)).alias("jaccard_cross"),
        F.median(F.size(p) - F.size(o)).alias("tokens_paraphrase"),
        F.median(F.size(i) - F.size(o)).alias("tokens_idiomatic"),
        F.median(F.size(o)).alias("length_original"),
    )
