"""From raw model output to labels: parsers, scoring and verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label words and the codes they stand for.
SENTIMENT = {"positive": "1", "negative": "0"}
RELATION = {"entailment": "0", "neutral": "1", "contradiction": "2"}
#: A standalone letter A to D of upper-cased text.
CHOICE = r"(?:^|[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])"
END_OF_THOUGHT = "</think>"


def strip_reasoning(raw: Column) -> Column:
    """What follows the first end-of-thought mark; the whole text if there is none."""
    at = F.locate(END_OF_THOUGHT, raw)
    return F.when(at > 0, F.substring(raw, at + len(END_OF_THOUGHT), F.length(raw))).otherwise(raw)


def first_word(raw: Column, codes: dict[str, str]) -> Column:
    """Code of the label word that occurs first, ignoring case; null if none does."""
    text = F.lower(strip_reasoning(raw))
    found = F.array(*[F.struct(F.locate(word, text).alias("at"), F.lit(code).alias("code")) for word, code in codes.items()])
    return F.array_min(F.filter(found, lambda f: f["at"] > 0))["code"]


def parse_sentiment(raw: Column) -> Column:
    return first_word(raw, SENTIMENT)


def parse_relation(raw: Column) -> Column:
    return first_word(raw, RELATION)


def parse_choice(raw: Column) -> Column:
    """'0' to '3' for the first standalone letter A to D; the article 'a' counts as one."""
    letter = F.regexp_extract(F.upper(strip_reasoning(raw)), CHOICE, 1)
    return F.when(letter != "", (F.ascii(letter) - 65).cast("string"))


PARSERS: dict[str, Callable[[Column], Column]] = {"sentiment": parse_sentiment, "choice": parse_choice, "relation": parse_relation}


def parse_status(parsed: Column) -> Column:
    return F.when(parsed.isNull(), "unparseable").otherwise("ok")


def score(parsed: Column, y: Column) -> Column:
    """Whether the label is right; what could not be parsed is wrong, not missing."""
    return F.coalesce(parsed == y.cast("string"), F.lit(False))


def parse_verdict(raw: Column) -> Column:
    """A judge's answer: PASS or FAIL; both or neither is MALFORMED and does not pass."""
    text = F.upper(F.coalesce(raw, F.lit("")))
    yes, no = F.contains(text, F.lit("PASS")), F.contains(text, F.lit("FAIL"))
    verdict = F.when(yes & ~no, "PASS").when(no & ~yes, "FAIL").otherwise("MALFORMED")
    return F.struct((verdict == "PASS").alias("passed"), verdict.alias("verdict"))
