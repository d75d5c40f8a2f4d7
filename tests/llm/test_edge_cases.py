"""Every text operator and pipeline stage on one awkward table.

Null ids and texts, empty, blank and very long texts, repeated rows, equal
texts, foreign scripts, and extra columns named like results or helpers.
"""

import random

import corpus_pipeline
import public_tokenizers as P
import pytest

from paravane.llm import bpe_tree, decontaminate, jaccard_join, langid, passages, quality, token_count, toxicity
from paravane.llm import queries as Q

EXTRA = "score string, n_tokens string, component_id string, rank string, h string, at string, words string, tiles string, gram string, row string, runs string, item_id string, k string, label string, __spans string, toxic string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
N_EXTRA = EXTRA.count(",") + 1


def awkward():
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = text(60_000)
    same = text(80)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "...!!"), (5, long), (6, same), (6, same), (7, same), (None, same), (None, None), (8, "漢字 текст ñ"), (9, "x" * 50_000), (10, "<|endoftext|>"), (11, "one two"), (12, "one two")]
    rows += [(20 + i, text(40)) for i in range(20)]
    return [(i, t, "en", None, None, *["clash"] * N_EXTRA) for i, t in rows], rows, long, same


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward()[0], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_row_operators_keep_every_row(spark, docs):
    every = ids(docs)
    none = docs.limit(0)
    labels = docs.selectExpr("doc_id", "text", "lang", "cast(doc_id % 2 AS double) AS rating", "cast(doc_id % 2 AS int) AS toxic")
    for run in (
        lambda d: langid.identify(d, labels.select("doc_id", "text", "lang")),
        lambda d: quality.grade(d, labels.select("doc_id", "text", "rating")),
        lambda d: toxicity.score(d, labels.select("doc_id", "text", "toxic")),
        lambda d: token_count.count_tokens(d, P.path(Q.TOKENIZER)),
        lambda d: bpe_tree.encode_decode(d, P.path(Q.RANKS), P.PATTERN),
        lambda d: jaccard_join.components(d),
    ):
        assert ids(run(docs)) == every and run(none).count() == 0


def test_round_trip_of_all_texts(docs):
    got = bpe_tree.encode_decode(docs, P.path(Q.RANKS), P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in got) == sorted(t or "" for _, t in awkward()[1])


def test_components(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert {(6, 76, 6), (7, 76, 6), (None, 76, None), (None, 0, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (11, 1, 11), (12, 1, 11), (4, 1, 4)} <= got


def test_passages(spark, docs):
    found = passages.find(docs)
    assert {(r["doc_id"], r["source_id"], r["n_words"]) for r in found.collect()} == {(7, 6, 80)}
    left = passages.remove(docs, found)
    assert left.columns == docs.columns and ids(left) == [i for i in ids(docs) if i != 7]  # all of 7 repeats 6
    assert passages.find(docs.limit(0)).count() == 0 and passages.remove(docs.limit(0), found).count() == 0


def test_leaks(spark, docs):
    _, _, long, same = awkward()
    items = spark.createDataFrame([(1, same, "x"), (2, " ".join(long.split()[100:130]), "x"), (3, None, "x"), (None, same, "x"), (4, "", "x"), (5, "ONE, two!", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.find(docs, items).collect()}
    assert got == {(6, 1, 0), (7, 1, 0), (5, 2, 100), (11, 5, 0), (12, 5, 0)}


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(20 + i, 1, int(i % 5 == 0)) for i in range(20)] + [(None, None, None), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf_dir)
    if k < 4:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    gone = sorted(set(ids(docs)) - set(ids(out)), key=str)
    want = {1: [12, 7], 2: [7], 3: [11, 12], 4: []}
    if k:
        assert gone == want[k]
    else:
        assert {1, 2, 3, None} <= set(ids(out))
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_queries_on_null_ids(spark, sf_dir):
    got = Q.op9_toxicity(spark, sf_dir).collect()
    assert sum(r["doc_id"] is None for r in got) == 2 and all(r["held_out"] is not None for r in got)


def test_an_id_that_holds_most_rows(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    hot, other = text(120), text(60)
    rows = [(5, hot)] * 3000 + [(6, hot + " " + other), (7, other + " " + text(70)), (8, text(90))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted({(r["doc_id"], r["source_id"], r["n_words"]) for r in passages.find(df).collect()}) == [(6, 5, 120), (7, 6, 60)]
    near = spark.createDataFrame([(5, hot)] * 3000 + [(6, hot + " tail"), (8, text(90))], "doc_id long, text string").repartition(7)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.components(near).collect()}
    assert got == {(5, 5), (6, 5), (8, 8)}
