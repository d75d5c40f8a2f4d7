"""Readers and writers round trip; evaluation, rewriting, resuming, streaming, configuration."""

import json

import pytest
from pyspark.sql import functions as F

from paravane import cli, config, registry, schemas
from paravane.plans import analyze, augment, evaluate, inference, sinks
from paravane.sources import results, variants
from paravane.streaming import incremental

ROW = schemas.VARIANT_ROW


def row(i, x, y="1", variant="original", **more):
    return tuple(({"id": i, "variant": variant, "x": x, "y": y, "meta": "{}", "augmenter_model": "", "prompt_hash": "", "validators": ""} | more)[c] for c in schemas.VARIANT_COLUMNS)


def test_csv_round_trip(spark, tmp_path):
    rows = [row("12345e67", 'say "hi", twice'), row("0012", "  two\nlines  "), row("3", ""), row("4", "NA"), row("5", "back\\slash \\\"")]
    path = str(tmp_path / "v")
    sinks.write_rows(spark.createDataFrame(rows, ROW).coalesce(1), path)
    back = variants.read_rows(spark, path)
    assert [tuple(r)[:8] for r in back.orderBy("row_idx").collect()] == rows
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_rows(back, path)
    assert [r["id"] for r in variants.first_rows(back, 2).collect()] == ["12345e67", "0012"]
    with pytest.raises(ValueError):
        variants.first_rows(back.limit(0), None)


def test_torn_tail_and_progress(spark, tmp_path):
    done = row("1", "a", variant="idiomatic", augmenter_model="m", prompt_hash="h", validators='{"v": {"passed": true, "score": 1.0, "details": {}}}')
    path = str(tmp_path / "v.csv")
    text = ",".join(schemas.VARIANT_COLUMNS) + "\n" + ",".join('"' + c.replace('"', '""') + '"' for c in done) + "\n2,idiomatic,torn"
    open(path, "w").write(text)
    got = variants.read_rows(spark, path, torn_tail=True)
    assert [r["id"] for r in got.collect()] == ["1"]
    assert variants.progress(got).first().asDict() == {"done": 1, "augmenter_model": "m", "prompt_hash": "h"}


def test_skip_manifest(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text(json.dumps([{"id": "1", "variant": "idiomatic", "reason": "validation_failed", "failing": ["x"], "attempts": 3}, {"nonsense": 1}]))
    bad.write_text("{not json")
    assert [r["id"] for r in variants.read_skips(spark, str(good)).collect()] == ["1"]
    assert variants.read_skips(spark, str(bad)).count() == 0


def result_file(root, dataset, model, outcomes, drop=None):
    def one(ok):
        return {"raw": "positive", "parsed": None if ok is None else "1", "parse_status": "unparseable" if ok is None else "ok", "correct": bool(ok)}

    tasks = [{"id": str(i), "y": "1", **{v: one(o) for v, o in zip(schemas.VARIANTS, t)}} for i, t in enumerate(outcomes)]
    if drop is not None:
        tasks[drop]["idiomatic"] = None
    path = root / dataset / f"{model}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"dataset": dataset, "model_id": model, "model_revision": "r", "config_hash": "c", "prompt_hash": "p", "variants_run": list(schemas.VARIANTS), "per_task": tasks}))
    return str(path)


def test_results_and_summary(spark, tmp_path):
    outcomes = [(1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1), (None, 1, 0)]
    for ds in ("a", "b"):
        for m in ("m1", "m2"):
            result_file(tmp_path, ds, m, outcomes)
    found = results.discover(spark, str(tmp_path))
    assert len(found) == 4 and found == sorted(found)
    runs = results.validated(results.read_results(spark, *found))
    table = analyze.summary(analyze.estimates(analyze.joint_cells(results.predictions(runs), strict=True), 500), runs)
    assert len(table.columns) == 17 and table.count() == 4
    r = table.first()
    assert (r["acc_original"], r["acc_paraphrase"], r["acc_idiomatic"]) == (0.6, 0.8, 0.6) and r["delta_idiom"] == pytest.approx(-0.2)
    assert len(analyze.cross_model(analyze.estimates(analyze.joint_cells(results.predictions(runs)), 500), runs).columns) == 23
    clean = analyze.parse_clean_table(results.predictions(runs)).first()
    assert clean["dropped"] == 0.2 and clean["d_clean"] == pytest.approx(0.0)
    cli.main(["analyze", "--results", str(tmp_path), "--out", str(tmp_path / "out"), "--resamples", "200"])
    assert (tmp_path / "out" / "summary.csv").read_text().count("\n") == 5 and json.loads((tmp_path / "out" / "summary.meta.json").read_text())["row_counts"] == {"runs": 4}
    with pytest.raises(sinks.Exists):
        cli.main(["analyze", "--results", str(tmp_path / ""), "--out", str(tmp_path / "out"), "--resamples", "200"])
    for command in ("variant-confusion", "report-tables"):
        cli.main([command, "--results", str(tmp_path), "--out", str(tmp_path / command), "--resamples", "200", "--force"])
    report = (tmp_path / "variant-confusion" / "a" / "reports" / "pooled_chi2_report.md").read_text()
    assert report.startswith("b = 2, c = 2")


def test_missing_variant_is_loud(spark, tmp_path):
    path = result_file(tmp_path, "a", "m", [(1, 1, 1), (1, 0, 1)], drop=1)
    with pytest.raises(Exception, match="lacks a variant"):
        results.validated(results.read_results(spark, path)).collect()
    assert analyze.joint_cells(results.predictions(results.read_results(spark, path))).first()["n"] == 1


def test_evaluate_resume_and_replay(spark):
    raws = ["positive", "negative", "invalid", "Positive!", "negative"]
    ys = ["1", "0", "1", "1", "0"]
    rows = spark.createDataFrame([(str(i), "original", f"t{i}", y, "{}", i) for i, y in enumerate(ys)], "id string, variant string, x string, y string, meta string, row_idx long")

    def load():
        return lambda chats: [raws[int(c[1]["content"].split("Sentence: t")[1][0])] for c in chats]

    infer = lambda df: inference.predict(df, load, 2)
    scored = evaluate.evaluate(rows, evaluate.SENTIMENT, infer)
    m = evaluate.run_metrics(scored).first()
    assert (m["accuracy"], m["unparseable_rate"], m["n"], m["n_unparseable"]) == (0.8, 0.2, 5, 1)
    half = scored.filter("row_idx < 2").withColumn("raw", F.lit("kept"))
    resumed = {r["id"]: r["raw"] for r in evaluate.evaluate(rows, evaluate.SENTIMENT, infer, half).collect()}
    assert resumed == {"0": "kept", "1": "kept", "2": "invalid", "3": "Positive!", "4": "negative"}
    again = evaluate.replay(rows, scored.select("id", "raw"), evaluate.SENTIMENT)
    assert evaluate.run_metrics(again).first() == m
    checkpoint = scored.withColumn("prompt_hash", F.lit("a")).withColumn("config_hash", F.lit("b"))
    assert evaluate.compatible(checkpoint, "a", "b").count() == 5
    with pytest.raises(Exception, match="another prompt"):
        evaluate.compatible(checkpoint, "a", "x").collect()


class Script:
    """A client that answers from a table."""

    def complete(self, prompt, temperature, max_output_tokens):
        if prompt.startswith("judge"):
            return "FAIL" if "bad" in prompt else "PASS"
        if "down" in prompt:
            raise inference.TransportError("429")
        return "" if "empty" in prompt else prompt.split(":")[1]


def rewrite(df):
    return inference.rewrite(df, Script, {"idiom_presence": lambda x, row: f"judge {x}"}, max_attempts=2, backoff=0)


def test_rewrite_skip_pause_resume_reconcile(spark):
    schema = "id string, x string, y string, meta string, row_idx long"
    tasks = spark.createDataFrame([("1", "good", "0", "{}", 0), ("2", "bad", "0", "{}", 1), ("3", "empty", "0", "{}", 2), ("4", "fine", "0", "{}", 3)], schema)
    b = augment.build_variant(tasks, "idiomatic", "rewrite:{x}", "m", rewrite)
    assert sorted((r["id"], r["x"]) for r in b.rows.collect()) == [("1", "good"), ("4", "fine")]
    assert sorted((r["id"], r["failing"], r["attempts"]) for r in b.skips.collect()) == [("2", ["idiom_presence"], 2), ("3", ["empty_output"], 2)] and not b.paused
    down = augment.build_variant(tasks.unionByName(spark.createDataFrame([("9", "down", "0", "{}", 4)], schema)), "idiomatic", "rewrite:{x}", "m", rewrite, b.rows, b.skips)
    assert down.paused and down.rows.count() == 2 and down.skips.count() == 2 and augment.finish({"idiomatic": down}) is None
    other = augment.build_variant(tasks.filter("id <> '4'"), "paraphrase", "rewrite:{x}", "m", rewrite)
    rows, skips = augment.finish({"paraphrase": other, "idiomatic": b})
    assert sorted((r["id"], r["variant"]) for r in rows.collect()) == [("1", "idiomatic"), ("1", "paraphrase")]
    assert ("4", "idiomatic", "unaligned") in {(r["id"], r["variant"], r["reason"]) for r in skips.collect()}
    stale = augment.build_variant(tasks, "idiomatic", "other:{x}", "m", rewrite, b.rows, b.skips)
    assert stale.rows.count() == 2 and stale.skips.count() == 2


def test_streaming_scores_incrementally(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(rows):
        spark.createDataFrame(rows, incremental.PREDICTION).coalesce(1).write.mode("append").parquet(source)
        incremental.score_stream(spark, source, target, check, evaluate.SENTIMENT).awaitTermination()

    arrive([("d", "m", "1", "original", "1", "negative", 0), ("d", "m", "2", "original", "1", "positive", 1)])
    arrive([("d", "m", "1", "original", "1", "positive", 0)])
    assert sorted((r["id"], r["correct"]) for r in incremental.latest(spark, target).collect()) == [("1", True), ("2", True)]


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("dataset: sentences\nseed: 0\nhf_revision: r\nlength: {min_tokens: 10, max_tokens: 100}\nmax_rows: null\nnormalize: [nfc]\ndedupe: true\n")
    cfg = config.load(config.CleanConfig, path, seed=5)
    assert cfg.seed == 5 and cfg.options().max_rows is None
    for broken in ("extra: 1\n", "normalize: [nope]\n"):
        path.write_text(path.read_text().replace("normalize: [nfc]\n", "") + broken)
        with pytest.raises(ValueError):
            config.load(config.CleanConfig, path)
    assert config.resolve_variants({"idiomatic", "original"}) == ["original", "idiomatic"]
    for wanted in (["nope"], ["paraphrase"]):
        with pytest.raises(ValueError):
            config.resolve_variants({"original"}, wanted)


def test_registry():
    r = registry.Registry("thing")
    r.register("b")(1)
    r.register("a")(2)
    assert r.names() == ["a", "b"] and r.get("a") == 2
    with pytest.raises(ValueError):
        r.register("a")(3)
    with pytest.raises(KeyError, match="known: a, b"):
        r.get("c")
    with pytest.raises(ValueError):
        registry.ModelSpec("m", "r", "v", kind="encoder")
    assert registry.pick_device(False, True) == "mps" and registry.pick_precision("cpu", "bf16") == "fp32"


def test_cache_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("h", "m", "1", "text"), ("h", "m", "2", None)], "prompt_hash string, augmenter_model string, id string, response string")
    sinks.append_cache(rows, str(tmp_path / "cache"))
    sinks.append_cache(rows, str(tmp_path / "off"), enabled=False)
    assert [r["id"] for r in variants.read_cache(spark, str(tmp_path / "cache")).collect()] == ["1"] and not (tmp_path / "off").exists()
    skips = spark.createDataFrame([("2", "idiomatic", "unaligned", [], 0), ("1", "idiomatic", "validation_failed", ["x"], 3)], schemas.SKIPPED)
    sinks.write_skips(skips, str(tmp_path / "skips"))
    assert sorted(r["id"] for r in variants.read_skips(spark, str(tmp_path / "skips")).collect()) == ["1", "2"]


def test_eval_and_clean_commands(spark, tmp_path, monkeypatch):
    raw = str(tmp_path / "raw")
    spark.createDataFrame([(f"word {i} here", i % 2) for i in range(8)], "sentence string, label int").coalesce(1).write.parquet(raw)
    cfg = tmp_path / "clean.yaml"
    cfg.write_text("dataset: sentences\nseed: 1\nhf_revision: r\nlength: {min_tokens: 1, max_tokens: 9}\nmax_rows: 6\nnormalize: [nfc, collapse_whitespace]\ndedupe: true\n")
    cli.main(["clean", "--config", str(cfg), "--raw", raw, "--out", str(tmp_path / "rows")])
    side = json.loads((tmp_path / "rows" / "sentences" / "original.meta.json").read_text())
    assert side["row_counts"]["written"] == 6 and side["row_counts"]["raw_loaded"] == 8
    (tmp_path / "rows" / "sentences").rename(tmp_path / "rows" / "sst2")
    model = tmp_path / "eval.yaml"
    model.write_text("model: m\n")
    cli.main(["eval", "--config", str(model), "--dataset", "sst2", "--rows", str(tmp_path / "rows"), "--results", str(tmp_path / "res"), "--client", "paravane.plans.q_more:stub_model"])
    assert spark.read.parquet(str(tmp_path / "res" / "sst2" / "m" / "original")).count() == 6
    with pytest.raises(SystemExit):
        cli.main(["clean"])


def test_panel():
    assert len(registry.MODELS.names()) == 14 and registry.ascending(list(registry.PARAMETERS.values()))
    assert registry.MODELS.get("yi-1.5-6b-chat").default_precision == "bf16"


def test_reports():
    assert sinks.points(None) == "---" and sinks.points(0.0123) == "+1.23" and sinks.points(-0.02, bold=True) == r"\textbf{$-$2.00}"
    text = sinks.latex_panels(["a", "b", "c"], {"a": "A"}, {("d", "a"): (0.01, 0.01)}, ["d"])
    assert text.count(r"\\") == 2 and "---" in text and r"\dagger" in text
    assert "non-significant verdict" in sinks.verdict_text(10, 5, 3.0, 0.08, 1, 9)
    assert sinks.markdown(["a"], [[None], [1.5]]) == "| a |\n|---|\n|  |\n| 1.5000 |\n"
    assert "<svg" in sinks.bars("t", [("m", 0.1, 0.0, 0.2)])
