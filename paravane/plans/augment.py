"""Building the rewritten variants: resume, cache, rewrite, validate, reconcile."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.functions import prompts
from paravane.functions import text as T
from paravane.operators import align, metrics
from paravane.plans.sinks import append_checkpoint
from paravane.schemas import PROGRESS, VARIANT_COLUMNS
from paravane.sources import paths
from paravane.sources.variants import read_progress, validator_results


@dataclass
class Build:
    """A variant after one session: kept rows, skips, the session's outcomes, and whether it must be resumed."""

    rows: DataFrame
    skips: DataFrame
    paused: bool
    session: DataFrame
    resumed: int


def stored(outcome: DataFrame) -> DataFrame:
    """Outcomes written out once, as evaluating them again would repeat the calls."""
    return outcome.checkpoint()


class Progress:
    """The table of a variant's outcomes: appended before they are used, read by the next session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.session = spark, path, uuid.uuid4().hex

    def seed(self, rows: DataFrame, skips: DataFrame | None) -> None:
        """Take over the rows (and skips) that another program left, once."""
        if paths.exists(self.spark, self.path):
            return
        done = rows.select(*VARIANT_COLUMNS, F.lit("ok").alias("status"), F.array().cast("array<string>").alias("failing"), F.lit(0).alias("attempts"))
        if skips is not None:
            of = rows.select("augmenter_model", "prompt_hash").limit(1)
            failed = skips.filter("reason = 'validation_failed'").crossJoin(F.broadcast(of))  # one row
            done = done.unionByName(failed.select("id", "variant", "augmenter_model", "prompt_hash", F.lit("skip").alias("status"), "failing", "attempts"), allowMissingColumns=True)
        self._append(done.withColumn("cached", F.lit(False)), "seed")

    def _append(self, outcome: DataFrame, session: str) -> None:
        append_checkpoint(outcome.select(*[c for c in PROGRESS.names if c != "session"], F.lit(session).alias("session")), self.path)

    def record(self, outcome: DataFrame) -> DataFrame:
        """The outcomes, appended to those of this session, and all of these read back."""
        self._append(outcome, self.session)
        return self.of_session()

    def of_session(self) -> DataFrame:
        return read_progress(self.spark, self.path).filter(F.col("session") == self.session)

    def kept(self) -> DataFrame:
        return read_progress(self.spark, self.path).filter("status = 'ok'")

    def skipped(self) -> DataFrame:
        """Rejected rows of any model and prompt."""
        return read_progress(self.spark, self.path).filter("status = 'skip'")


def augment_prompt(template: str) -> Column:
    """The rewriting prompt of a row, from a template with {y}, {x} and {context}."""
    meta = prompts.parse_meta(F.col("meta"))
    return prompts.fill(template, y=F.col("y"), x=F.col("x"), context=prompts.render_context(meta))


def judge_prompt(template: str) -> Column:
    """A judge's prompt from {original} and {rewritten} (and {y}, {context})."""
    meta = prompts.parse_meta(F.col("meta"))
    return prompts.fill(template, original=F.col("x"), rewritten=F.col("rewritten"), y=F.col("y"), context=prompts.render_context(meta))


def build_variant(tasks: DataFrame, variant: str, template: str, augmenter_model: str, rewrite: Callable[[DataFrame], DataFrame], existing: DataFrame | None = None, skips: DataFrame | None = None, cache: DataFrame | None = None, record: Callable[[DataFrame], DataFrame] = stored, chunks: int = 1) -> Build:
    """One variant of the tasks.

    Rows that ``existing`` holds for the same model and prompt are kept, skipped ids are not tried
    again, rows that ``cache`` answers are taken from there, and the rest goes through ``rewrite``
    ((id, prompt, x, y, meta, context) -> (id, rewritten, status, failing, attempts, validators)).
    ``record`` stores outcomes and reads back all of this session, so that no call is made twice;
    with ``chunks`` it does so after each part of the rows, and no further part is asked for after a
    transient failure.
    Rows of another model or prompt are stale, and their skips with them.  A transient failure
    pauses the variant: its row is neither kept nor skipped.
    """
    digest = prompt_digest(tasks.sparkSession, template)
    kept = align.resumable(existing, augmenter_model, digest) if existing is not None else None
    known = skips.filter(F.col("variant") == variant) if skips is not None else None
    if known is not None and "prompt_hash" in known.columns:
        known = align.resumable(known, augmenter_model, digest)
    elif existing is not None and known is not None and kept.isEmpty():
        known = None
    todo = tasks if kept is None else align.remaining(tasks, kept, known)
    if kept is None and known is not None:
        todo = align.remaining(tasks, known)
    todo = todo.select("id", "x", "y", "meta", F.lit(variant).alias("variant"), F.lit(augmenter_model).alias("augmenter_model"), F.lit(digest).alias("prompt_hash"))
    ask, answered = todo, None
    if cache is not None:
        looked_up = align.with_cache(todo, cache.filter("validators IS NOT NULL"), carry=["validators"])
        answered = looked_up.filter("hit").select("id", F.col("cached").alias("rewritten"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("failing"), F.lit(0).alias("attempts"), "validators", F.lit(True).alias("cached"))
        ask = looked_up.filter("NOT hit")
    context = prompts.render_context(prompts.parse_meta(F.col("meta")))
    asked = ask.select("id", augment_prompt(template).alias("prompt"), "x", "y", "meta", context.alias("context"))
    for n in range(chunks):
        # rows are chosen before they are asked for: a filter on the answers would ask for all of them
        found = rewrite(asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == n)).withColumn("cached", F.lit(False))
        if answered is not None and not n:
            found = found.unionByName(answered)
        outcome = record(found.join(todo.drop("x"), "id").withColumnRenamed("rewritten", "x"))
        if not outcome.filter("status = 'transient'").isEmpty():
            break
    rows = outcome.filter("status = 'ok'").select(*VARIANT_COLUMNS)
    columns = ["id", F.lit(variant).alias("variant"), F.lit("validation_failed").alias("reason"), "failing", "attempts"]
    failed = outcome.filter("status = 'skip'").select(*columns)
    if kept is not None:
        rows = rows.unionByName(kept.select(*VARIANT_COLUMNS))
    if known is not None:
        failed = failed.unionByName(known.select(*(columns if "reason" not in known.columns else failed.columns)))
    return Build(rows, failed, not outcome.filter("status = 'transient'").isEmpty(), outcome, 0 if kept is None else kept.count())


def prompt_digest(spark: SparkSession, template: str) -> str:
    return spark.range(1).select(T.short_hash(F.lit(template)).alias("h")).first()["h"]


def finish(builds: dict[str, Build]) -> tuple[DataFrame, DataFrame] | None:
    """Rows reduced to the ids that all variants have, and all skips; None while a variant is paused."""
    if any(b.paused for b in builds.values()):
        return None
    parts = list(builds.values())
    rows, skips = parts[0].rows, parts[0].skips
    for b in parts[1:]:
        rows, skips = rows.unionByName(b.rows), skips.unionByName(b.skips)
    names = tuple(builds)
    return align.reconcile(rows, names), skips.unionByName(align.unaligned_skips(rows, skips, names))


def counts(build: Build, rows: DataFrame, skips: DataFrame, input_rows: int) -> tuple[dict, dict]:
    """Row counts and cache figures of a variant's sidecar, after reconciliation."""
    tally = metrics.validator_tally(validator_results(rows), []).collect()
    session = build.session.agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses")).first()
    written = rows.count()
    figures = {"input_rows": input_rows, "augmented": written, "written": written, "skipped": build.resumed, "dropped": skips.count()}
    figures["validators_passed_by_name"] = {r["name"]: r["passed"] for r in tally}
    figures["validators_failed_by_name"] = {r["name"]: r["failed"] for r in tally if r["failed"]}
    return figures, {"hits": session["hits"], "misses": session["misses"]}
