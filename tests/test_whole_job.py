"""Registered queries work on whole texts, with as many resamples as the operators."""

import os
import re

import pytest

from paravane.operators import bootstrap
from paravane.plans import analyze, q_figures, q_rows

SF = "/root/testdata/sf0.001"


def test_choice_parse_reads_whole_texts(spark, tmp_path):
    long = "word " * 100
    texts = ["b first", long + "(c) last", long + "nothing", "a thought " + long + "</think> so D", None, "", "x" * 199 + " a", "x" * 198 + " Bxy"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def parse(text):
        found = re.search(r"(?:^|\W)([A-D])(?:$|\W)", text.split("</think>", 1)[-1].upper()) if text else None
        return found and str("ABCD".index(found[1]))

    got = {r["doc_id"]: r["parsed"] for r in q_rows.p16_choice_parse(spark, str(tmp_path)).collect()}
    assert got == {i: parse(t) for i, t in rows} and got[1] == "2" and got[3] == "3"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_bootstrap_queries_resample_as_the_operators(spark):
    cells = q_figures.cells_of(spark, SF).cache()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    summary = analyze.summary(analyze.estimates(cells, 10_000), q_figures.runs(spark))
    assert rows(q_figures.a15_summary(spark, SF)) == rows(summary)
    assert rows(q_figures.a17_cross_dataset_significant(spark, SF)) == rows(analyze.significant(analyze.cross_dataset(summary)))
    assert rows(q_figures.a16_cross_model(spark, SF)) == rows(analyze.cross_model(analyze.estimates(cells, 10_000), q_figures.runs(spark)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_agreement_resamples_as_the_operators(spark, monkeypatch):
    seen, table = [], bootstrap.difference_table

    def spy(cells, keys, resamples=10_000, seed=0):
        seen.append(resamples)
        return table(cells, keys, resamples, seed)

    monkeypatch.setattr(bootstrap, "difference_table", spy)
    assert q_figures.a19_test_agreement(spark, SF).count() and seen == [10_000]
