"""The augment and eval commands over several sessions, with clients that count their calls."""

import json

import pytest

from paravane import cli, config, schemas
from paravane.plans import decoder, evaluate, inference, sinks
from paravane.sources import paths, providers, variants

#: What the fake provider does, and the prompts it was asked; a file, as workers are other processes.
CALLS = "calls.txt"


class Fake:
    """Answers rewrites and judges; fails as the folder's files tell it."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompt, temperature, max_output_tokens):
        with open(f"{self.folder}/{CALLS}", "a") as log:
            log.write(prompt.replace("\n", " ") + "\n")
        if prompt.startswith("judge"):
            return "FAIL" if "second" in prompt and self.on("reject") else "PASS"
        if self.on("down") and "second" in prompt:
            raise providers.TransportError("429")
        if self.on("empty") and "second" in prompt:
            raise providers.EmptyResponse("nothing")
        return prompt.split(":")[1] + " rewritten"

    def on(self, name):
        import os

        return os.path.exists(f"{self.folder}/{name}")


FOLDER = None


def client():
    return Fake(FOLDER)


@pytest.fixture
def job(spark, tmp_path, monkeypatch):
    """A job folder; run(**settings) runs the command and returns the rewriting calls it made."""
    columns = list(schemas.VARIANT_COLUMNS)
    texts = ["first", "second", "third", "fourth", "fifth"]
    rows = [(str(i), "original", t, "1", "{}", "", "", "") for i, t in enumerate(texts, 1)]
    sinks.write_rows(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).coalesce(1), str(tmp_path / "rows" / "d" / "original"))
    for name in ("paraphrase", "idiomatic"):
        (tmp_path / f"{name}.txt").write_text(name + ":{x}:{y}{context}")
    (tmp_path / "judge.txt").write_text("judge {original} / {rewritten} / {context}")
    monkeypatch.setattr(cli, "named", lambda reference, folder=str(tmp_path): lambda: Fake(folder))

    def run(model="m1", expect_pause=False, cache=True, chunks=1):
        calls = tmp_path / CALLS
        calls.write_text("")
        (tmp_path / "c.yaml").write_text(
            f"dataset: d\naugmenter: gemini\naugmenter_model: {model}\nretry: {{max_attempts: 2, backoff_seconds: 0}}\n"
            f"prompts: {{paraphrase: {tmp_path}/paraphrase.txt, idiomatic: {tmp_path}/idiomatic.txt}}\n"
            f"validators: {{label_preservation: {{prompt: {tmp_path}/judge.txt}}}}\ncache: {{enabled: {str(cache).lower()}, dir: {tmp_path}/cache}}\n"
        )
        argv = ["augment", "--config", str(tmp_path / "c.yaml"), "--rows", str(tmp_path / "rows"), "--client", "x:y", "--chunks", str(chunks)]
        if expect_pause:
            with pytest.raises(SystemExit, match="paused"):
                cli.main(argv)
        else:
            cli.main(argv)
        return [line for line in calls.read_text().splitlines() if not line.startswith("judge")]

    run.folder = tmp_path
    run.ids = lambda v: sorted(r["id"] for r in variants.read_rows(spark, str(tmp_path / "rows" / "d" / v)).collect())
    run.skips = lambda v: sorted((r["id"], r["reason"]) for r in variants.read_skips(spark, str(tmp_path / "rows" / "d" / f"{v}.skips")).collect())
    run.side = lambda v: json.loads((tmp_path / "rows" / "d" / f"{v}.meta.json").read_text())
    return run


def test_augment_pause_resume_nothing_to_do_and_other_model(spark, job):
    root = job.folder / "rows" / "d"
    (job.folder / "down").touch()
    paused = job(expect_pause=True)
    assert {c.split(":")[0] for c in paused} == {"paraphrase"} and sum("second" in c for c in paused) == 2
    assert not (root / "paraphrase").exists() and not (root / "idiomatic").exists() and not (root / "paraphrase.meta.json").exists()
    done = len({c for c in paused if "second" not in c})
    (job.folder / "down").unlink()
    resumed = job()
    assert len(resumed) == (5 - done) + 5  # what was bought already is not bought again
    assert job.ids("paraphrase") == job.ids("idiomatic") == list("12345") and job.skips("paraphrase") == []
    side = job.side("paraphrase")
    assert side["row_counts"]["skipped"] == done and side["row_counts"]["written"] == 5 and side["row_counts"]["validators_passed_by_name"] == {"label_preservation": 5, "semantic_similarity": 5}
    for _ in range(2):
        assert job() == []
        assert job.ids("paraphrase") == job.ids("idiomatic") == list("12345")
    assert len(job(model="m2")) == 10
    assert job.side("idiomatic")["row_counts"]["skipped"] == 0
    rows = variants.read_rows(spark, str(root / "paraphrase"))
    assert {r["augmenter_model"] for r in rows.collect()} == {"gemini/m2"}
    assert rows.filter("id = '1'").first()["x"] == "first rewritten"


def test_augment_in_chunks_asks_once_a_row(spark, job):
    assert sorted(job(chunks=3)) == sorted(f"{v}:{t}:1" for v in ("paraphrase", "idiomatic") for t in ("first", "second", "third", "fourth", "fifth"))
    assert job.ids("paraphrase") == list("12345") and job(chunks=2) == []


def test_augment_skips_are_not_tried_again(spark, job):
    (job.folder / "reject").touch()
    assert len(job()) == 2 * (4 + 2)
    (job.folder / "reject").unlink()
    assert job() == []
    assert job.ids("paraphrase") == job.ids("idiomatic") == ["1", "3", "4", "5"]
    assert job.skips("paraphrase") == [("2", "validation_failed")]


def test_augment_empty_answer_is_a_skip_of_both(spark, job):
    (job.folder / "empty").touch()
    assert len(job()) == 2 * (4 + 2)
    assert job.ids("idiomatic") == ["1", "3", "4", "5"] and job.side("idiomatic")["row_counts"]["dropped"] == 1


def test_augment_takes_over_stored_rows_and_cache(spark, job):
    import shutil

    job()
    for v in ("paraphrase", "idiomatic"):
        shutil.rmtree(job.folder / "rows" / "d" / f"{v}.progress")
    assert job(cache=False) == []  # the variant files alone
    for v in ("paraphrase", "idiomatic"):
        shutil.rmtree(job.folder / "rows" / "d" / f"{v}.progress")
        shutil.rmtree(job.folder / "rows" / "d" / v)
    assert job() == []  # the cache alone
    assert job.side("paraphrase")["cache_stats"] == {"hits": 5, "misses": 0} and job.ids("idiomatic") == list("12345")


def test_torn_tail_at_every_cut(spark, tmp_path):
    head = ",".join(schemas.VARIANT_COLUMNS) + "\n"
    one, two = ('{i},idiomatic,"a, b",0,{{}},m,h,"{{""v"": {{""passed"": true}}}}"\n'.format(i=i) for i in (1, 2))
    for cut in range(1, len(two), 7):
        path = tmp_path / f"{cut}.csv"
        path.write_text(head + one + two[:cut])
    whole = tmp_path / "whole.csv"
    whole.write_text(head + one + two)
    for path in sorted(tmp_path.glob("*.csv")):
        got = sorted(r["id"] for r in variants.read_rows(spark, str(path), torn_tail=True).collect())
        assert got == (["1", "2"] if path == whole else ["1"]), path
        assert path.read_text() == (head + one + two if path == whole else head + one)
    assert not paths.cut_torn_line(spark, str(whole))


def test_file_order_over_files(spark, tmp_path):
    head = ",".join(schemas.VARIANT_COLUMNS) + "\n"
    for k, n in enumerate((3, 400, 1, 50)):  # sizes of any order
        (tmp_path / f"part-{k}.csv").write_text(head + "".join(f"{k}-{i:03d},original,x,0,{{}},,,\n" for i in range(n)))
    got = [r["id"] for r in variants.read_rows(spark, str(tmp_path)).orderBy("row_idx").collect()]
    assert got == sorted(got) and len(got) == 454


class Model:
    def __init__(self, folder):
        self.folder = folder

    def __call__(self, chats):
        with open(f"{self.folder}/{CALLS}", "a") as log:
            log.write("x\n" * len(chats))
        return ["positive"] * len(chats)


def test_eval_resumes_and_its_result_is_analysed(spark, tmp_path, monkeypatch):
    rows = tmp_path / "rows"
    for v in schemas.VARIANTS:
        data = [(str(i), v, f"text {i}", str(i % 2), "{}", "", "", "") for i in range(6)]
        sinks.write_rows(spark.createDataFrame(data, ", ".join(f"{c} string" for c in schemas.VARIANT_COLUMNS)).coalesce(1), str(rows / "sst2" / v))
    monkeypatch.setattr(cli, "named", lambda reference, folder=str(tmp_path): lambda: Model(folder))
    (tmp_path / "e.yaml").write_text("model: yi-1.5-6b-chat\n")
    argv = ["eval", "--config", str(tmp_path / "e.yaml"), "--dataset", "sst2", "--rows", str(rows), "--results", str(tmp_path / "res"), "--client", "x:y", "--chunks", "3"]
    # a session that ended after half of the first variant
    cfg = config.load(config.EvalConfig, tmp_path / "e.yaml", seed=0)
    hashes = {"prompt_hash": spark.range(1).select(evaluate.SENTIMENT.prompt_hash().alias("h")).first()["h"], "config_hash": evaluate.config_hash(cfg.model_dump())}
    store = evaluate.Checkpoint(spark, str(tmp_path / "res" / ".progress" / "sst2" / "yi-1.5-6b-chat" / "original"), **hashes)
    first = variants.read_rows(spark, str(rows / "sst2" / "original")).filter("int(id) < 3")
    evaluate.evaluate(first, evaluate.SENTIMENT, lambda df: inference.predict(df, lambda: lambda chats: ["negative"] * len(chats)), None, store.record)
    cli.main(argv)
    assert (tmp_path / CALLS).read_text().count("x") == 3 + 6 + 6 and not (tmp_path / "res" / ".progress" / "sst2" / "yi-1.5-6b-chat").exists()
    found = json.loads((tmp_path / "res" / "sst2" / "yi-1.5-6b-chat.json").read_text())
    assert found["metrics"]["original"]["accuracy"] == pytest.approx(4 / 6) and len(found["per_task"]) == 6 and found["model_revision"].startswith("77")
    with pytest.raises(sinks.Exists):
        cli.main(argv)
    cli.main(["analyze", "--results", str(tmp_path / "res"), "--out", str(tmp_path / "out"), "--resamples", "50"])
    assert (tmp_path / "out" / "summary.csv").read_text().count("yi-1.5-6b-chat") == 1
    for command in (["plot-dataset", "--dataset", "sst2"], ["plot-summary"], ["variant-confusion"], ["report-tables"]):
        cli.main([*command, "--results", str(tmp_path / "res"), "--out", str(tmp_path / "out"), "--resamples", "50", "--force"])
    out = tmp_path / "out"
    assert (out / "sst2_cross_model.html").read_text().count("<svg") == 2 and (out / "cross_dataset.html").read_text().count("<svg") == 1
    figure, report = (out / "sst2" / "figures" / "yi-1.5-6b-chat_confusion.html").read_text(), (out / "sst2" / "reports" / "yi-1.5-6b-chat_chi2_report.md").read_text()
    assert figure.count("<tr>") == 9 and "only idiomatic" in figure and all(h in report for h in ("## Question", "## Counts", "## Corrected test", "## Bootstrap", "## Decision"))
    # a checkpoint of another configuration is refused
    stale = evaluate.Checkpoint(spark, store.path, hashes["prompt_hash"], "other")
    evaluate.evaluate(first, evaluate.SENTIMENT, lambda df: inference.predict(df, lambda: lambda chats: ["negative"] * len(chats)), None, stale.record)
    with pytest.raises(Exception, match="another prompt or configuration"):
        cli.main([*argv, "--force"])


def test_providers_by_their_public_interfaces(monkeypatch):
    replies = {
        "anthropic": {"content": [{"type": "text", "text": " yes "}]},
        "gemini": {"candidates": [{"content": {"parts": [{"text": "thinking", "thought": True}, {"text": "yes"}]}}]},
        "openai": {"choices": [{"message": {"content": "yes\n"}}]},
    }
    for p in providers.PROVIDERS:
        monkeypatch.delenv(p.key_variable, raising=False)
        with pytest.raises(providers.TransportError, match=p.key_variable):
            providers.HostedModel(p, "m")
        monkeypatch.setenv(p.key_variable, "secret")
        asked = []
        send = lambda url, headers, body, reply=replies[p.name], asked=asked: asked.append((url, headers, body)) or reply
        assert providers.HostedModel(p, "m", send).complete("ask", 0.5, 9) == "yes"
        url, headers, body = asked[0]
        assert any("secret" in v for v in headers.values()) and "ask" in json.dumps(body) and ("m" in body.get("model", "") or "/m:" in url)
        for empty in ({}, {"content": []}, {"candidates": []}, {"choices": []}):
            with pytest.raises(providers.EmptyResponse):
                providers.HostedModel(p, "m", lambda *_, empty=empty: empty).complete("ask", 0.5, 9)


class Tokenizer:
    def __init__(self, template, system):
        self.chat_template, self.system = template, system

    def apply_chat_template(self, chat, tokenize, add_generation_prompt):
        if not self.system and any(m["role"] == "system" for m in chat):
            raise ValueError("no such role")
        return "|".join(f"{m['role']}={m['content']}" for m in chat)


def test_chat_rendering_and_generation():
    chat = [{"role": "system", "content": "s"}, {"role": "user", "content": "u {system}"}]
    with_role, without = Tokenizer("t", True), Tokenizer("t", False)
    assert decoder.takes_system(with_role) and not decoder.takes_system(without)
    assert decoder.render_chat(with_role, chat, True) == "system=s|user=u {system}"
    assert decoder.render_chat(without, chat, False) == "user=s\n\nu {system}"
    assert decoder.render_chat(Tokenizer(None, False), chat, False, "[{system}] {user}") == "[s] u {system}"
    with pytest.raises(ValueError):
        decoder.render_chat(Tokenizer(None, False), chat, False)
    assert decoder.generation(0.7, 5) == {"max_new_tokens": 5, "do_sample": False}
    assert decoder.generation(0.7, 5, True)["temperature"] == 0.7
    import random

    assert decoder.seed_everything(3)[:2] == ["random", "numpy"]
    a = random.random()
    decoder.seed_everything(3)
    assert random.random() == a


def test_configuration_faults(tmp_path):
    good = {"dataset": "d", "augmenter": "openai", "augmenter_model": "m", "prompts": {"paraphrase": "p", "idiomatic": "i"}}
    cfg = config.AugmentConfig.of(good)
    assert cfg.retry.max_attempts == 3 and cfg.validators.semantic_similarity.min_cosine == 0.8 and cfg.cache.enabled and cfg.model_dump()["judge"] == {"temperature": 0.0, "max_output_tokens": 16}
    for bad in (
        {"validators": {"no_such_check": {"bogus": 1}}},
        {"validators": {"idiom_presence": {"bogus": 1}}},
        {"validators": {"semantic_similarity": {"min_cosine": "high"}}},
        {"augmenter": "nobody"},
        {"seed": True},
        {"prompts": {"paraphrase": "p"}},
        {"retry": 3},
        {"extra": 1},
    ):
        with pytest.raises(ValueError):
            config.AugmentConfig.of(good | bad)
    for bad in ({}, {"model": "m", "precision": "fp8"}, {"model": "m", "decoding": {"temperature": -1}}, [1]):
        with pytest.raises(ValueError):
            config.EvalConfig.of(bad)
    assert config.EvalConfig.of({"model": "m", "precision": None}).precision is None
