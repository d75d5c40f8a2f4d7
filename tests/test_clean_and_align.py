"""Cleaning, loaders and alignment."""

import pytest

from paravane.operators import align, clean
from paravane.schemas import VARIANTS
from paravane.sources import tasks as loaders

TASK = "id string, x string, y string, meta string, row_idx long"


def test_band_edges(spark):
    rows = [(str(n), " ".join("w" * n), "0", "{}", n) for n in (2, 3, 4, 5)]
    out = clean.clean(spark.createDataFrame(rows, TASK), clean.CleanOptions(min_words=3, max_words=4))
    assert sorted(r["id"] for r in out.collect()) == ["3", "4"]


def test_dedupe_keeps_the_first_of_each_key(spark):
    rows = [("1", "hello world", "0", "{}", 1), ("2", "hello  world", "0", "{}", 2), ("3", "hello world", "1", "{}", 3), ("4", "hello world", "0", '{"a":1}', 4)]
    df = spark.createDataFrame(rows, TASK)
    options = clean.CleanOptions(min_words=1, max_words=9)
    assert sorted(r["id"] for r in clean.clean(df, options).collect()) == ["1", "3", "4"]
    assert clean.step_counts(df, options).first().asDict() == {"raw_loaded": 4, "after_normalize": 4, "after_length_filter": 4, "after_dedupe": 3, "after_shuffle_and_cap": 3, "written": 3}
    off = clean.CleanOptions(min_words=1, max_words=9, dedupe=False, max_rows=2)
    assert clean.clean(df, off).count() == 2 and clean.step_counts(df, off).first()["after_dedupe"] == 4


def test_seeded_order_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(str(i), f"a b {i}", "0", "{}", i) for i in range(20)], TASK)

    def order(seed, parts, cap=None):
        options = clean.CleanOptions(min_words=1, max_words=9, seed=seed, max_rows=cap)
        return [r["id"] for r in clean.clean(df.repartition(parts), options).collect()]

    assert order(42, 1) == order(42, 7) != order(43, 1)
    assert order(42, 3, 5) == order(42, 1)[:5]


def test_pairs_loader(spark):
    schema = "promptID long, pairID string, premise string, hypothesis string, genre string, label int, row_idx long"
    first = [(1, "a", "p", "h", "g", -1, 0), (1, "b", "p", "h", "g", 2, 1), (1, "c", "p", "h", "g", 0, 2), (2, "d", "q", "h", "g", 1, 3)]
    second = [(2, "e", "q", "h", "g", 0, 0), (3, "f", "r", "h", "g", 0, 1)]
    got = loaders.pairs([spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)])
    assert sorted((r["id"], r["y"]) for r in got.collect()) == [("b", "2"), ("d", "1"), ("f", "0")]


def test_read_indexed_is_contiguous(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 5).write.parquet(path)
    got = loaders.read_indexed(spark, path).select("id", "row_idx").collect()
    assert sorted(r["row_idx"] for r in got) == list(range(1000))
    s = loaders.sentences([spark.createDataFrame([("Good  film", 1, 0)], "sentence string, label int, row_idx long")]).first()
    import hashlib

    assert s["id"] == hashlib.sha256(b"Good film").hexdigest()[:16] and s["x"] == "Good  film"


PRED = "id string, variant string, correct boolean"


def test_two_alignment_policies(spark):
    rows = [("1", v, True) for v in VARIANTS] + [("2", "original", True), ("2", "idiomatic", False)]
    df = spark.createDataFrame(rows, PRED)
    assert [r["id"] for r in align.triples(df, ["id"]).collect()] == ["1"]
    with pytest.raises(Exception, match="missing variants paraphrase for 2"):
        align.require_triples(df, ["id"]).collect()
    assert align.require_triples(df.filter("id = '1'"), ["id"]).count() == 1


def test_reconcile_and_skips(spark):
    rows = [(i, v) for v in ("paraphrase", "idiomatic") for i in "123" if (i, v) != ("2", "paraphrase")]
    df = spark.createDataFrame(rows, "id string, variant string")
    names = ("paraphrase", "idiomatic")
    known = spark.createDataFrame([("2", "paraphrase")], "id string, variant string")
    assert sorted(map(tuple, align.reconcile(df, names).collect())) == sorted((i, v) for i in "13" for v in names)
    assert [(r["id"], r["variant"], r["reason"]) for r in align.unaligned_skips(df, known, names).collect()] == [("2", "idiomatic", "unaligned")]


def test_lookups(spark):
    rows = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2)], "id string, row_idx long")
    prior = spark.createDataFrame([("1", "r1"), ("2", "r2")], "id string, raw string")
    with pytest.raises(Exception, match="no stored output for 3"):
        align.replayed(rows, prior).collect()
    assert align.replayed(rows.filter("id <> '3'"), prior).count() == 2
    with pytest.raises(Exception, match="more than once: 1"):
        align.unique_ids(spark.createDataFrame([("1", 1), ("1", 2)], "id string, v int"), ["id"]).collect()
    last = align.last_per_id(spark.createDataFrame([("1", "a", 0), ("1", "b", 1)], "id string, v string, row_idx long"), ["id"], "row_idx").first()
    assert last["v"] == "b"
    existing = spark.createDataFrame([("1", "m", "h"), ("2", "m", "old")], "id string, augmenter_model string, prompt_hash string")
    assert [r["id"] for r in align.resumable(existing, "m", "h").collect()] == ["1"]
