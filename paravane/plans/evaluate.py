"""Evaluation: prompts, scoring, per-variant metrics, checkpoints and replay."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.functions import parsers, prompts
from paravane.functions import text as T
from paravane.operators import align, metrics
from paravane.registry import register_evaluator
from paravane.schemas import VARIANTS
from paravane.sources import paths


class Evaluator:
    """How one kind of task is asked and read."""

    def __init__(self, system: str, template: str, chat: Callable[[Column, Column], Column], parse: Callable[[Column], Column]):
        self.system, self.template, self.chat, self.parse = system, template, chat, parse

    def prompt_hash(self) -> Column:
        return T.short_hash(F.concat(F.lit(self.system), F.lit(T.SEPARATOR), F.lit(self.template)))

    def formatted(self, rows: DataFrame) -> DataFrame:
        """Rows with their chat messages."""
        return rows.withColumn("messages", self.chat(F.col("x"), prompts.parse_meta(F.col("meta"))))

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows of (raw, y, ...) with parsed, parse_status and correct: one projection, whatever the batches were."""
        out = rows.withColumn("parsed", self.parse(F.col("raw")))
        return out.withColumn("parse_status", parsers.parse_status(F.col("parsed"))).withColumn("correct", parsers.score(F.col("parsed"), F.col("y")))


SENTIMENT = register_evaluator("sst2")(Evaluator(prompts.SENTIMENT_SYSTEM, prompts.SENTIMENT_USER, lambda x, meta: prompts.sentiment_messages(x), parsers.parse_sentiment))
CHOICE = register_evaluator("mmlu")(Evaluator(prompts.CHOICE_SYSTEM, prompts.CHOICE_USER, prompts.choice_messages, parsers.parse_choice))
RELATION = register_evaluator("mnli")(Evaluator(prompts.PAIR_SYSTEM, prompts.PAIR_USER, prompts.pair_messages, parsers.parse_relation))


#: Columns of a scored prediction.
SCORED = ("id", "variant", "y", "raw", "parsed", "parse_status", "correct", "row_idx")


def evaluate(rows: DataFrame, evaluator: Evaluator, infer: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, record: Callable[[DataFrame], DataFrame] | None = None, chunks: int = 1) -> DataFrame:
    """Scored predictions for variant rows: (id, variant, y, raw, parsed, parse_status, correct, row_idx).

    ``infer`` adds ``raw``.  Rows that ``done`` holds already are not sent again, but merged in;
    ``record`` stores new ones, after each of ``chunks`` parts, and reads back all of this session.
    """
    keys = ["id", "variant"]
    todo = rows if done is None else rows.join(done.select(*keys), keys, "left_anti")
    for n in range(chunks if record else 1):
        # rows are chosen before inference: a filter on its results would run it on all of them
        part = todo if chunks == 1 or not record else todo.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == n)
        new = evaluator.scored(infer(evaluator.formatted(part))).select(*SCORED)
        new = record(new) if record else new
    return new if done is None else new.unionByName(done.join(rows.select(*keys), keys, "left_semi").select(*SCORED))


class Checkpoint:
    """Scored rows of an unfinished run, appended job by job; one of another prompt or configuration is refused."""

    def __init__(self, spark: SparkSession, path: str, prompt_hash: str, config_hash: str):
        self.spark, self.path, self.hashes, self.session = spark, path, (prompt_hash, config_hash), uuid.uuid4().hex

    def read(self) -> DataFrame | None:
        """What earlier sessions scored, or None."""
        if not paths.exists(self.spark, f"{self.path}/rows"):
            return None
        # read once, so that rows of this session do not join those that were there before it
        kept = compatible(self.spark.read.parquet(f"{self.path}/rows"), *self.hashes).select(*SCORED)
        return kept.checkpoint()

    def record(self, scored: DataFrame) -> DataFrame:
        """Scored rows, appended to those of this session, and all of these read back."""
        scored.withColumns({"prompt_hash": F.lit(self.hashes[0]), "config_hash": F.lit(self.hashes[1]), "session": F.lit(self.session)}).write.mode("append").parquet(f"{self.path}/rows")
        return self.spark.read.parquet(f"{self.path}/rows").filter(F.col("session") == self.session).select(*SCORED)

    def add_time(self, seconds: float) -> float:
        """The seconds of this session and of those before it."""
        self.spark.createDataFrame([(seconds,)], "seconds double").write.mode("append").parquet(f"{self.path}/seconds")
        return self.spark.read.parquet(f"{self.path}/seconds").agg(F.sum("seconds").alias("s")).first()["s"]


def config_hash(config: dict) -> str:
    """Hash of a configuration's JSON, keys in order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def replay(rows: DataFrame, prior: DataFrame, evaluator: Evaluator) -> DataFrame:
    """Stored raw outputs parsed and scored again, without inference; each row must have one."""
    return evaluator.scored(align.replayed(rows, prior))


def compatible(checkpoint: DataFrame, prompt_hash: str, config_hash: str) -> DataFrame:
    """A checkpoint of the same prompt and configuration; one of another is refused at run time."""
    same = (F.col("prompt_hash") == prompt_hash) & (F.col("config_hash") == config_hash)
    return checkpoint.filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the checkpoint is of another prompt or configuration"))))


def per_task(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per aligned task: y and, for each variant, a struct of its outcome."""
    packed = predictions.withColumn("__o", F.struct("raw", "parsed", "parse_status", "correct"))
    return align.with_labels(align.triples(packed, ["id"], "__o"), labels)


def run_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics over every row of each variant, aligned or not."""
    return metrics.variant_metrics(predictions, [])


def result(predictions: DataFrame, about: dict) -> dict:
    """A run's result document: what it was, each variant's metrics, and its aligned tasks one by one.

    The document is for exchange with other programs and is put together on the driver; the
    predictions themselves are stored as a table.
    """
    found = {r["variant"]: r.asDict(recursive=True) for r in run_metrics(predictions).collect()}
    unparsed = predictions.filter("parse_status <> 'ok'").orderBy("row_idx").select("variant", "id").collect()
    lines = per_task(predictions, predictions.filter("variant = 'original'").select("id", "y")).toJSON().collect() if set(about["variants_run"]) == set(VARIANTS) else []
    metrics_of = {v: {k: x for k, x in r.items() if k in ("accuracy", "unparseable_rate", "n", "n_unparseable")} for v, r in found.items()}
    return {"stage": "eval", **about, "metrics": metrics_of, "unparseable_ids": {v: [r["id"] for r in unparsed if r["variant"] == v] for v in about["variants_run"]}, "per_task": [_task(json.loads(line)) for line in lines]}


def _task(task: dict) -> dict:
    """A task of a result document; a text that was not parsed is null there."""
    return {"id": task["id"], "y": task.get("y", ""), **{v: {"parsed": None, **task[v]} for v in VARIANTS}}
