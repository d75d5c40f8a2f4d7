"""The pipeline on a small planted corpus, stage by stage and as a whole."""

import random

import corpus_pipeline
import pytest

BAD = ["moron", "scum", "idiot"]


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, kind = [], {}
    leak, shared = " ".join(text(30)), text(70)
    for i in range(240):
        t = text(rng.choice([30, 80, 200]))
        kind[i] = "clean"
        if i % 8 == 1:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(BAD))
            kind[i] = "toxic"
        elif i % 8 == 3 and i > 20:
            t, kind[i] = rows[i - 11][1].split(), "copy"  # i - 11 is a clean row
        elif i % 8 == 5:
            t[5:5], kind[i] = [leak], "leak"
        elif i % 8 == 6:
            t[3:3], kind[i] = shared, "passage"
        rows.append((i, " ".join(t), "en", "s", 1))
    rows += [(900, "", "en", "s", 0), (901, None, None, None, None)]
    return rows, kind, leak


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, kind, leak = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(kind[i] == "toxic")) for i in kind], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run(spark, sf_dir):
    rows, kind, _ = corpus()
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    first_passage = min(i for i in kind if kind[i] == "passage")
    want = {i for i in kind if kind[i] in ("clean", "passage")} | {900, 901}
    assert set(out) == want
    for i, t, *_ in rows:
        if i in out and i < 900:
            r = out[i]
            assert r["n_tokens"] * 4 == len(r["token_ids"]) and r["n_chars"] == len(r["text"])
            if kind[i] == "passage" and i != first_passage:
                assert len(t.split()) - len(r["text"].split()) == 70
            else:
                assert r["text"] == t
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "byte-level BPE"]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_nothing_is_left_of_a_stage(spark, tmp_path):
    from paravane.llm.common import passing, settle

    with passing(spark):
        kept = settle(spark.range(5))
        file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert store.exists(path) and kept.count() == 5
    assert not store.exists(path)
    settle(spark.range(3))  # outside, files stay
