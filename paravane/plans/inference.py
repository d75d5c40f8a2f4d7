"""External calls as data: batched inference, rewriting with retries, and judges.

Calls are paid for, so ``augment`` writes their results to a table before it
uses them; failures are rows with a status, not exceptions, and clients are
made once per worker by a factory.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paravane.functions import parsers
from paravane.registry import register_validator
from paravane.sources.providers import EmptyResponse, TransportError

#: Checks of each rewritten variant, in order.
CHECKS = {"paraphrase": ("label_preservation", "idiom_absence", "semantic_similarity"), "idiomatic": ("label_preservation", "idiom_presence", "semantic_similarity")}


class Client(Protocol):
    def complete(self, prompt: str, temperature: float, max_output_tokens: int) -> str: ...


def predict(df: DataFrame, load: Callable[[], Callable[[list], list[str]]], batch_size: int = 8, progress: Accumulator | None = None) -> DataFrame:
    """Adds ``raw``, the model's output for ``messages``; ``load`` makes the model once per worker.

    ``progress`` counts the answers on the driver after every batch.
    """
    schema = StructType([*df.schema.fields, StructField("raw", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            outputs: list[str] = []
            chats = pdf["messages"].tolist()
            for i in range(0, len(chats), batch_size):
                found = model(chats[i : i + batch_size])
                if len(found) != len(chats[i : i + batch_size]):
                    raise ValueError("the model must answer each prompt of a batch")
                outputs += found
                if progress is not None:
                    progress.add(len(found))
            yield pdf.assign(raw=outputs)

    return df.mapInPandas(run, schema)


def fill_text(template: str, slots: dict[str, str]) -> str:
    """A template with its {name} slots filled once; braces inside the values stay as they are."""
    return re.sub(r"\{(\w+)\}", lambda m: str(slots.get(m[1], m[0])), template)


def judge(template: str) -> Callable[[str, dict], str]:
    """Renders a judge's prompt from a rewrite and its row (x, y, context)."""
    return lambda x, row: fill_text(template, {"original": row["x"], "rewritten": x, "y": row["y"], "context": row["context"]})


for _name in ("label_preservation", "idiom_presence", "idiom_absence"):
    register_validator(_name)(judge)


def verdict(text: str) -> str:
    """PASS or FAIL, if exactly one of them is said; else MALFORMED, which does not pass."""
    said = [word for word in ("PASS", "FAIL") if word in text.upper()]
    return said[0] if len(said) == 1 else "MALFORMED"


def attempt(client: Client, prompt: str, judge_prompts: dict[str, Callable[[str], str]], temperature: float, max_output_tokens: int, max_attempts: int, backoff: float, judge_temperature: float = 0.0, judge_tokens: int = 16) -> dict:
    """One row's rewrite and verdicts.

    status 'ok', 'skip' (rejected or empty at least once) or 'transient' (only the transport failed).
    """
    failing, rejected, tries = [], False, 0
    for tries in range(1, max_attempts + 1):
        try:
            x = client.complete(prompt, temperature, max_output_tokens)
            if not x.strip():
                raise EmptyResponse("no text")
            verdicts = {name: verdict(client.complete(render(x), judge_temperature, judge_tokens)) for name, render in judge_prompts.items()}
            failing = [name for name, v in verdicts.items() if v != "PASS"]
            if not failing:
                return {"x": x, "status": "ok", "failing": [], "attempts": tries, "verdicts": verdicts}
            rejected = True
        except EmptyResponse:
            failing, rejected = ["empty_output"], True
        except TransportError as fault:
            failing = [f"transport: {fault}"]
        if tries < max_attempts and backoff > 0:
            time.sleep(backoff * 2 ** (tries - 1))
    return {"x": None, "status": "skip" if rejected else "transient", "failing": failing, "attempts": tries, "verdicts": {}}


def rewrite(df: DataFrame, make_client: Callable[[], Client], judges: dict[str, Callable[[str, dict], str]], temperature: float = 0.7, max_output_tokens: int = 512, max_attempts: int = 3, backoff: float = 2.0, judge_temperature: float = 0.0, judge_tokens: int = 16) -> DataFrame:
    """(id, rewritten, status, failing, attempts, validators) for rows of (id, prompt, ...).

    Judges render their prompt from the rewrite and the row; validators holds their verdicts as
    JSON.  After a transient failure a task asks the provider no more: its remaining rows are
    transient with 0 attempts, and a later session takes them up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, down = make_client(), False
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                if down:
                    rows.append((row["id"], None, "transient", [], 0, "{}"))
                    continue
                renders = {name: (lambda x, f=f, row=row: f(x, row)) for name, f in judges.items()}
                found = attempt(client, row["prompt"], renders, temperature, max_output_tokens, max_attempts, backoff, judge_temperature, judge_tokens)
                down = found["status"] == "transient"
                checks = {name: {"passed": True, "score": None, "details": {"verdict": v}} for name, v in found["verdicts"].items()}
                if found["status"] == "ok":
                    checks["semantic_similarity"] = {"passed": True, "score": 1.0, "details": {}}
                rows.append((row["id"], found["x"], found["status"], found["failing"], found["attempts"], json.dumps(checks, sort_keys=True)))
            yield pd.DataFrame(rows, columns=["id", "rewritten", "status", "failing", "attempts", "validators"])

    return df.mapInPandas(run, "id string, rewritten string, status string, failing array<string>, attempts int, validators string")


@register_validator("semantic_similarity")
def semantic_similarity() -> Column:
    """The similarity gate passes everything with score 1, as its threshold is not in force."""
    return F.struct(F.lit(True).alias("passed"), F.lit(1.0).alias("score"), F.create_map().cast("map<string,string>").alias("details"))


def chain_passed(validators: str = "validators") -> Column:
    """Whether all checks of a validators map passed."""
    return F.forall(F.map_values(validators), lambda v: v["passed"])


def judged(df: DataFrame, raw: str = "raw") -> DataFrame:
    """A judge's raw answers as (passed, verdict)."""
    return df.withColumn("judgement", parsers.parse_verdict(F.col(raw))).select("*", "judgement.*").drop("judgement")
