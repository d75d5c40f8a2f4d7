"""Command line: one command for each stage and report."""

from __future__ import annotations

import argparse
import functools
import importlib
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane import config
from paravane.operators import bootstrap, clean, metrics, statistics
from paravane.plans import analyze, augment, decoder, evaluate, inference, sinks
from paravane.plans.analyze import KEYS
from paravane.registry import AUGMENTERS, DATASETS, EVALUATORS, MODELS, PARAMETERS
from paravane.schemas import VARIANTS
from paravane.sources import paths, providers, results, tasks, variants


def session() -> SparkSession:
    return SparkSession.builder.appName("paravane").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load_cells(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Validated results and their joint cells."""
    found = results.discover(spark, root)
    if not found:
        raise SystemExit(f"no result files under {root}")
    runs = results.validated(results.read_results(spark, *found)).cache()
    return runs, analyze.joint_cells(results.predictions(runs), strict=True).cache()


def clean_one(spark: SparkSession, path: Path, raw: str, out: str, seed: int | None, force: bool) -> None:
    cfg = config.load(config.CleanConfig, path, seed=seed)
    loader = DATASETS.get(cfg.dataset)
    splits = [tasks.read_indexed(spark, p) for p in raw.split(",")]
    rows = (loader(splits[0]) if loader is tasks.choices else loader(splits)).cache()
    target = f"{out}/{cfg.dataset}"
    kept = clean.clean(rows, cfg.options()).select("id", F.lit("original").alias("variant"), "x", "y", "meta", *[F.lit("").alias(c) for c in ("augmenter_model", "prompt_hash", "validators")])
    sinks.write_rows(kept, f"{target}/original", force)
    counts = clean.step_counts(rows, cfg.options()).first().asDict()
    sinks.write_json(f"{target}/original.meta.json", sinks.sidecar("clean", cfg.model_dump(), counts))


def run_clean(spark: SparkSession, a: argparse.Namespace) -> None:
    if bool(a.config) == bool(a.all):
        raise SystemExit("give either --config or --all")
    paths = [Path(a.config)] if a.config else sorted(Path(a.all).glob("*.yaml"))
    if a.all:
        have = {config.load(config.CleanConfig, p).dataset for p in paths}
        if missing := sorted(set(DATASETS.names()) - have):
            raise SystemExit(f"no configuration for: {', '.join(missing)}")
    for p in paths:
        clean_one(spark, p, a.raw, a.out, a.seed, a.force)


def named(reference: str):
    """The object that 'module:name' refers to."""
    module, _, name = reference.partition(":")
    return getattr(importlib.import_module(module), name)


def run_augment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Build both rewritten variants; run it again to resume.

    Outcomes are appended to ``<variant>.progress`` before they are used, in ``--chunks`` jobs; a
    later session asks only for rows that have none, or that the response cache does not know.
    --client is 'module:factory' of an object with complete(prompt, temperature,
    max_output_tokens); by default the configured provider.
    """
    cfg = config.load(config.AugmentConfig, a.config, seed=a.seed)
    decoder.seed_everything(cfg.seed)
    model, root = f"{cfg.augmenter}/{cfg.augmenter_model}", f"{a.rows}/{cfg.dataset}"
    make = named(a.client) if a.client else functools.partial(providers.HostedModel, AUGMENTERS.get(cfg.augmenter), cfg.augmenter_model)
    templates = {"paraphrase": Path(cfg.prompts.paraphrase).read_text(), "idiomatic": Path(cfg.prompts.idiomatic).read_text()}
    source, builds = variants.read_rows(spark, f"{root}/original"), {}
    for variant, template in templates.items():
        path = f"{root}/{variant}"
        progress = augment.Progress(spark, f"{path}.progress")
        if paths.exists(spark, path) and not paths.exists(spark, progress.path):
            prior = variants.read_rows(spark, path, torn_tail=True)
            progress.seed(prior, variants.read_skips(spark, f"{path}.skips") if paths.exists(spark, f"{path}.skips") else None)
        judges = {name: inference.judge(Path(settings.prompt).read_text()) for name in inference.CHECKS[variant] if (settings := getattr(cfg.validators, name)) and getattr(settings, "prompt", None)}
        rewrite = functools.partial(inference.rewrite, make_client=make, judges=judges, temperature=cfg.decoding.temperature, max_output_tokens=cfg.decoding.max_output_tokens, max_attempts=cfg.retry.max_attempts, backoff=cfg.retry.backoff_seconds, judge_temperature=cfg.judge.temperature, judge_tokens=cfg.judge.max_output_tokens)
        cache = variants.read_cache(spark, cfg.cache.dir) if cfg.cache.enabled and paths.exists(spark, cfg.cache.dir) else None
        builds[variant] = build = augment.build_variant(source, variant, template, model, rewrite, progress.kept(), progress.skipped(), cache, progress.record, a.chunks)
        bought = build.session.filter("status = 'ok' AND NOT cached").withColumnRenamed("x", "response")
        if cfg.cache.enabled and not bought.isEmpty():
            sinks.append_cache(bought, cfg.cache.dir)
        if build.paused:
            raise SystemExit(f"{variant}: paused by the provider; run again to resume")
    rows, skips = augment.finish(builds)
    total = source.count()
    for variant in templates:
        path, own = f"{root}/{variant}", skips.filter(F.col("variant") == variant)
        sinks.replace_rows(rows.filter(F.col("variant") == variant), path)
        sinks.write_skips(own, f"{path}.skips")
        written, skipped = variants.read_rows(spark, path), variants.read_skips(spark, f"{path}.skips")
        figures, cached = augment.counts(builds[variant], written, skipped, total)
        side = sinks.sidecar("augment", cfg.model_dump(), figures, cache_stats=cached, augmenter_model=model, prompt_hash=augment.prompt_digest(spark, templates[variant]))
        sinks.write_text(spark, f"{path}.meta.json", sinks.json_text(side))


def run_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    """Evaluate every variant; run it again to resume.

    Scored rows are appended to a checkpoint, in ``--chunks`` jobs; one of another prompt or
    configuration is refused.  It is removed when the result file is written.  --client is
    'module:loader' of a function from chats to texts; by default the configured model is loaded.
    """
    cfg, evaluator = config.load(config.EvalConfig, a.config, seed=a.seed), EVALUATORS.get(a.dataset)
    decoder.seed_everything(cfg.seed)
    load = named(a.client) if a.client else decoder.decoder(MODELS.get(cfg.model), cfg.decoding.model_dump(), cfg.precision, seed=cfg.seed)
    name = cfg.model.replace("/", "_")
    target, check = f"{a.results}/{a.dataset}/{name}", f"{a.results}/.progress/{a.dataset}/{name}"
    sinks.guard(f"{target}.json", a.force, spark)
    hashes = {"prompt_hash": spark.range(1).select(evaluator.prompt_hash().alias("h")).first()["h"], "config_hash": evaluate.config_hash(cfg.model_dump())}
    on_disk = {v for v in VARIANTS if paths.exists(spark, f"{a.rows}/{a.dataset}/{v}")}
    run = config.resolve_variants(on_disk, a.variants.split(",") if a.variants else None)
    spent, rows_of = {}, {}
    for v in run:
        rows_of[v] = rows = variants.first_rows(variants.read_rows(spark, f"{a.rows}/{a.dataset}/{v}"), a.limit, v)
        store = evaluate.Checkpoint(spark, f"{check}/{v}", **hashes)
        began = time.monotonic()
        predicted = evaluate.evaluate(rows, evaluator, lambda df: inference.predict(df, load, cfg.batch.size), store.read(), store.record, a.chunks)
        predicted.withColumn("model_id", F.lit(cfg.model)).withColumn("dataset", F.lit(a.dataset)).write.mode("overwrite").parquet(f"{target}/{v}")
        spent[v] = store.add_time(time.monotonic() - began)
        evaluate.run_metrics(spark.read.parquet(f"{target}/{v}")).show(truncate=False)
    predictions = spark.read.parquet(*[f"{target}/{v}" for v in run]).drop("model_id", "dataset")
    spec = MODELS.get(cfg.model) if cfg.model in MODELS.names() else None
    about = {"dataset": a.dataset, "model_id": cfg.model, "model_revision": spec.revision if spec else "", "hf_repo": spec.repo if spec else "", "precision": cfg.precision or (spec.default_precision if spec else None), "config_path": str(a.config), "resolved_config": cfg.model_dump(), "seed": cfg.seed, "variants_run": run, "wall_time_seconds": spent, **hashes}
    sinks.write_text(spark, f"{target}.json", sinks.json_text(evaluate.result(predictions, about)))
    paths.remove(spark, check)


def run_replay(spark: SparkSession, a: argparse.Namespace) -> None:
    """Score stored raw outputs again and print the metrics of each variant."""
    evaluator = EVALUATORS.get(a.dataset)
    on_disk = {v for v in VARIANTS if paths.exists(spark, f"{a.rows}/{a.dataset}/{v}")}
    for v in config.resolve_variants(on_disk, a.variants.split(",") if a.variants else None):
        rows = variants.first_rows(variants.read_rows(spark, f"{a.rows}/{a.dataset}/{v}"), a.limit, v)
        prior = results.predictions(results.read_results(spark, a.results)).filter(F.col("variant") == v).select("id", "raw")
        evaluate.run_metrics(evaluate.replay(rows, prior, evaluator)).show(truncate=False)


def run_analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    runs, cells = load_cells(spark, a.results)
    found = analyze.estimates(cells, a.resamples, a.ci, a.seed)
    sinks.write_table(analyze.summary(found, runs).orderBy("dataset", "model_id"), a.out, "summary", a.force)
    sinks.write_json(f"{a.out}/summary.meta.json", sinks.sidecar("analyze", {"resamples": a.resamples, "ci": a.ci, "seed": a.seed}, {"runs": runs.count()}, provenance=sinks.provenance(runs)))


def run_plot_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    runs, cells = load_cells(spark, a.results)
    table = analyze.cross_model(analyze.estimates(cells.filter(F.col("dataset") == a.dataset), a.resamples, a.ci, a.seed), runs).cache()
    for name, part in ((f"{a.dataset}_cross_model", table), (f"{a.dataset}_cross_model_significant", analyze.significant(table))):
        if part.isEmpty():
            continue
        sinks.write_table(part, a.out, name, a.force)
        sinks.atomic_text(f"{a.out}/{name}.html", sinks.dataset_figure(name, [r.asDict() for r in part.collect()]))


def run_plot_summary(spark: SparkSession, a: argparse.Namespace) -> None:
    runs, cells = load_cells(spark, a.results)
    table = analyze.cross_dataset(analyze.summary(analyze.estimates(cells, a.resamples, a.ci, a.seed), runs)).cache()
    for name, part in (("cross_dataset", table), ("cross_dataset_significant", analyze.significant(table))):
        if not part.isEmpty():
            sinks.write_table(part.orderBy(*KEYS), a.out, name, a.force)
            sinks.atomic_text(f"{a.out}/{name}.html", sinks.facets_figure([r.asDict() for r in part.collect()]))


def run_confusion(spark: SparkSession, a: argparse.Namespace) -> None:
    found = results.predictions(results.read_results(spark, *results.discover(spark, a.results)))
    cells = metrics.pooled(analyze.joint_cells(found), KEYS, "model_id").cache()
    tests = {tuple(r[k] for k in KEYS): r for r in statistics.mcnemar_table(cells, KEYS).collect()}
    boots = {tuple(r[k] for k in KEYS): r for r in bootstrap.difference_table(cells, KEYS, a.resamples, a.seed).collect()}
    for (ds, model), t in sorted(tests.items()):
        b = boots[ds, model]
        own = cells.filter((F.col("dataset") == ds) & (F.col("model_id") == model))
        confusion, causes = metrics.confusion(own, KEYS).drop(*KEYS).cache(), metrics.sole_cause(own, KEYS).drop(*KEYS).cache()
        sinks.write_table(confusion, f"{a.out}/{ds}/tables", f"{model}_confusion", a.force)
        sinks.write_table(causes, f"{a.out}/{ds}/tables", f"{model}_sole_cause", a.force)
        sinks.atomic_text(f"{a.out}/{ds}/figures/{model}_confusion.html", sinks.confusion_figure(f"{ds} {model}", [r.asDict() for r in confusion.collect()], [r.asDict() for r in causes.collect()]))
        sinks.atomic_text(f"{a.out}/{ds}/reports/{model}_chi2_report.md", sinks.confusion_report(f"{ds}: {model}", t["n"], t["b"], t["c"], t["chi2"], t["p_value"], b["ci_low"], b["ci_high"], b["p_value"], a.resamples))
        for part in (confusion, causes):
            part.unpersist()


def run_naive(spark: SparkSession, a: argparse.Namespace) -> None:
    analyze.naive_contrast(load_cells(spark, a.results)[1]).orderBy("dataset").show(truncate=False)


def run_overlap(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [variants.read_rows(spark, f"{a.rows}/{ds}/{v}").select(F.lit(ds).alias("dataset"), "id", "variant", "x") for ds in a.datasets.split(",") for v in VARIANTS]
    texts = parts[0]
    for p in parts[1:]:
        texts = texts.unionByName(p)
    analyze.arm_overlap(texts, ["dataset"]).show(truncate=False)


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    _, cells = load_cells(spark, a.results)
    table = statistics.with_exact_p(metrics.accuracies(cells), delta_idiom_p="idiom").cache()
    rows = [r.asDict() for r in analyze.dataset_summary(table).orderBy("dataset").collect()]
    sinks.atomic_text(f"{a.out}/summary.tex", sinks.latex_summary(rows))
    deltas = {(r["dataset"], r["model_id"]): (r["delta_idiom"], r["delta_idiom_p"]) for r in table.collect()}
    models = [m for m in PARAMETERS if any(k[1] == m for k in deltas)] or sorted({k[1] for k in deltas})
    sinks.atomic_text(f"{a.out}/per_model.tex", sinks.latex_panels(models, {}, deltas, sorted({k[0] for k in deltas})))


def run_trend(spark: SparkSession, a: argparse.Namespace) -> None:
    _, cells = load_cells(spark, a.results)
    sizes = spark.createDataFrame(list(PARAMETERS.items()), "model_id string, params double")
    trend = analyze.scale_trend(metrics.accuracies(cells), sizes)
    trend.orderBy("dataset").show(truncate=False)
    analyze.strongest(trend).show(truncate=False)


def run_agreement(spark: SparkSession, a: argparse.Namespace) -> None:
    _, cells = load_cells(spark, a.results)
    analyze.test_agreement(statistics.mcnemar_table(cells, KEYS), bootstrap.difference_table(cells, KEYS, a.resamples, a.seed)).show()


COMMANDS = {"clean": run_clean, "augment": run_augment, "eval": run_eval, "replay": run_replay, "analyze": run_analyze, "plot-dataset": run_plot_dataset, "plot-summary": run_plot_summary, "variant-confusion": run_confusion, "naive-contrast": run_naive, "arm-overlap": run_overlap, "report-tables": run_report, "scale-trend": run_trend, "test-agreement": run_agreement}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paravane")
    each = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = each.add_parser(name)
        p.add_argument("--results", default="results")
        p.add_argument("--rows", default="datasets_out")
        p.add_argument("--out", default="out")
        p.add_argument("--force", action="store_true")
        p.add_argument("--seed", type=int, default=None if name == "clean" else 0)
        p.add_argument("--resamples", type=int, default=10_000)
        p.add_argument("--ci", type=float, default=0.95)
        p.add_argument("--limit", type=int)
        p.add_argument("--chunks", type=int, default=8, help="jobs that a session's calls are split into; each one's results are kept when it ends")
        p.add_argument("--config")
        p.add_argument("--all", help="folder with a configuration for each dataset")
        p.add_argument("--raw", help="Parquet tables of the splits, comma-separated")
        p.add_argument("--dataset")
        p.add_argument("--datasets", default="sst2,mmlu,mnli")
        p.add_argument("--variants")
        p.add_argument("--client", help="module:name of a client factory or model loader")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](session(), a)


if __name__ == "__main__":
    main()
