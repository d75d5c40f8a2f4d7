"""Text functions, prompts and parsers on literal cases."""

import pytest
from pyspark.sql import functions as F

from paravane.functions import parsers, prompts, special
from paravane.functions import text as T


def values(spark, rows, expression, schema="x string"):
    df = spark.createDataFrame(rows, schema).repartition(1)
    return [r[0] for r in df.select(expression).collect()]


def test_whitespace_and_nfc(spark):
    cases = ["  a   b\t\tc\n\nd  ", "a b c", "\x1ca\x1f b\x85", "", "   ", None]
    assert values(spark, [(c,) for c in cases], T.collapse_whitespace(F.col("x"))) == ["a b c d", "a b c", "a b", "", "", None]
    once = T.normalize(["nfc", "collapse_whitespace"], F.col("x"))
    assert values(spark, [("café  x",)], once) == ["café x"]
    assert values(spark, [("café x",)], T.normalize(["collapse_whitespace", "nfc"], once)) == ["café x"]
    with pytest.raises(KeyError):
        T.normalize(["nope"], F.col("x"))


def test_words_hashes_tokens(spark):
    assert values(spark, [("",), ("a",), ("a b c",)], T.word_count(F.col("x"))) == [0, 1, 3]
    import hashlib

    assert values(spark, [("abc",)], T.short_hash(F.col("x"))) == [hashlib.sha256(b"abc").hexdigest()[:16]]
    assert values(spark, [("abc",)], T.short_hash(F.col("x"), F.lit("d"))) == [hashlib.sha256(b"abc\x1ed").hexdigest()[:16]]
    assert values(spark, [("Don't stop_it, Ünï 42",)], T.tokens(F.col("x"))) == [["don", "t", "stop_it", "ünï", "42"]]
    j = T.token_jaccard(T.tokens(F.col("x")), T.tokens(F.col("y")))
    assert values(spark, [("a b c", "b c d"), ("", "!"), ("a a", "a")], j, "x string, y string") == [0.5, 1.0, 1.0]


THOUGHT = "<think>negative, A, neutral</think>"


@pytest.mark.parametrize(
    "name,cases",
    [
        ("sentiment", {"positive": "1", "NEGATIVE.": "0", "It is Positive, not negative": "1", "negative or positive": "0", "": None, "good": None, THOUGHT + "positive": "1", "<think>positive": "1", "unnegatived": "0"}),
        ("choice", {"A": "0", "b.": "1", "(C)": "2", "The answer is D": "3", "E": None, "": None, "Apple": None, "a dog, so B": "0", THOUGHT + " D": "3", "<think>A or B": "0", "B_": None, "\nC\n": "2"}),
        ("relation", {"entailment": "0", "Neutral": "1", "CONTRADICTION!": "2", "neutral, not entailment": "1", "none": None, THOUGHT + "contradiction": "2"}),
    ],
)
def test_parsers(spark, name, cases):
    got = values(spark, [(c,) for c in cases], parsers.PARSERS[name](F.col("x")))
    assert dict(zip(cases, got)) == cases


def test_score_and_verdict(spark):
    rows = [("1", "1"), ("0", "1"), (None, "1")]
    assert values(spark, rows, parsers.score(F.col("x"), F.col("y")), "x string, y string") == [True, False, False]
    verdicts = values(spark, [("PASS",), ("pass",), ("Fail.",), ("maybe",), ("PASS or FAIL",), ("",), (None,)], parsers.parse_verdict(F.col("x")))
    assert [(v["passed"], v["verdict"]) for v in verdicts] == [(True, "PASS"), (True, "PASS"), (False, "FAIL")] + [(False, "MALFORMED")] * 4


def test_context_is_an_allowlist(spark):
    metas = ['{"choices": ["x", "y"], "answer_index": 1, "subject": "s"}', '{"hypothesis": "h", "label_name": "neutral", "prompt_id": 3, "genre": "g"}', "{}", "broken", "[1]", None]
    got = values(spark, [(m,) for m in metas], prompts.render_context(prompts.parse_meta(F.col("x"))))
    assert got[0] == "Answer choices:\nA) x\nB) y\n\n"
    assert got[1] == prompts.HYPOTHESIS_NOTE + "h\n\nGold label in words: neutral\n\n"
    assert got[2:] == [""] * 4


def test_templates_insert_once(spark):
    out = prompts.fill("{y}|{x}|{context}", x=F.col("x"), y=F.lit("L"), context=F.lit(""))
    assert values(spark, [("{y} {x}",)], out) == ["L|{y} {x}|"]
    chat = values(spark, [("q",)], prompts.fold_system(prompts.sentiment_messages(F.col("x"))))[0]
    assert len(chat) == 1 and chat[0]["role"] == "user" and chat[0]["content"].endswith("Sentence: q\nAnswer:")


def test_choice_text(spark):
    meta = prompts.parse_meta(F.lit('{"choices": ["a", "b", "c", "d"]}'))
    assert values(spark, [(0,), (3,), (4,), (-1,), (-5,)], prompts.choice_text(meta, F.col("x")), "x int") == ["a", "d", "", "d", ""]


def test_special_functions():
    assert abs(special.chi2_tail(3.841458820694124) - 0.05) < 1e-12
    assert abs(special.t_two_sided(2.178812829663418, 12) - 0.05) < 1e-9
    assert abs(special.t_quantile(0.975, 12) - 2.178812829663418) < 1e-9
    assert round(special.least_detectable_rho(14, 0.05), 2) == 0.53
    assert abs(special.binomial_tail(5, 14, 0.05) - 4e-4) < 5e-5
    assert abs(special.binomial_tail(1, 14, 0.05) - 0.51) < 5e-3
    assert abs(special.binomial_tail(10, 14, 0.05) - 8e-11) < 1e-11
