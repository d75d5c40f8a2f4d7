"""Prompt rendering: metadata, read-only context, templates and chat messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paravane import schemas

#: The evaluation prompts, part of the definition of a run.
SENTIMENT_SYSTEM = 'You are a sentiment classifier. Read the sentence and respond with exactly one word: either "positive" or "negative".'
SENTIMENT_USER = "Sentence: {x}\nAnswer:"
CHOICE_SYSTEM = "You are answering a multiple-choice question. Read the question and the four choices, then respond with exactly one letter: A, B, C, or D."
CHOICE_USER = "Question: {question}\nA. {A}\nB. {B}\nC. {C}\nD. {D}\nAnswer:"
PAIR_SYSTEM = 'You are a natural language inference classifier. Read the premise and the hypothesis, then respond with exactly one word: "entailment", "neutral", or "contradiction".'
PAIR_USER = "Premise: {premise}\nHypothesis: {hypothesis}\nAnswer:"
HYPOTHESIS_NOTE = (
    "Hypothesis (fixed reference — it is never rewritten; the rewritten text must\n"
    "preserve exactly the same logical relationship to it, and must not restate,\n"
    "quote, negate, or otherwise give away that relationship):\n"
)


def parse_meta(meta: Column, schema=schemas.CONTEXT_META) -> Column:
    """Metadata as a struct; malformed text, JSON that is no object and null give null fields."""
    return F.coalesce(F.from_json(meta, schema), F.from_json(F.lit("{}"), schema))


def fill(template: str, **slots: Column) -> Column:
    """A template with ``{name}`` slots.  Slot values are inserted once: braces inside them stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    columns = [F.coalesce(slots[p], F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p]
    return F.concat(*columns) if columns else F.lit("")


def render_context(meta: Column) -> Column:
    """Choices, hypothesis and label word, where present, each followed by an empty line; nothing else of the metadata."""
    lines = F.transform(meta["choices"], lambda c, i: F.concat(F.chr(i + 65), F.lit(") "), c))
    sections = F.array(
        F.when(F.size(meta["choices"]) > 0, F.concat(F.lit("Answer choices:\n"), F.array_join(lines, "\n"))),
        F.when(F.length(meta["hypothesis"]) > 0, F.concat(F.lit(HYPOTHESIS_NOTE), meta["hypothesis"])),
        F.when(F.length(meta["label_name"]) > 0, F.concat(F.lit("Gold label in words: "), meta["label_name"])),
    )
    text = F.array_join(F.array_compact(sections), "\n\n")
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n\n")))


def choice_text(meta: Column, index: Column) -> Column:
    """The text of a choice, counted from 0 (negative from the end); '' if there is none."""
    choices = meta["choices"]
    place = F.when(index < 0, index).otherwise(index + 1)
    return F.coalesce(F.try_element_at(choices, place), F.lit(""))


def messages(system: str, user: Column) -> Column:
    def one(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(one("system", F.lit(system)), one("user", user))


def sentiment_messages(x: Column) -> Column:
    return messages(SENTIMENT_SYSTEM, fill(SENTIMENT_USER, x=x))


def choice_messages(x: Column, meta: Column) -> Column:
    letters = {letter: F.try_element_at(meta["choices"], F.lit(i + 1)) for i, letter in enumerate("ABCD")}
    return messages(CHOICE_SYSTEM, fill(CHOICE_USER, question=x, **letters))


def pair_messages(x: Column, meta: Column) -> Column:
    return messages(PAIR_SYSTEM, fill(PAIR_USER, premise=x, hypothesis=meta["hypothesis"]))


def fold_system(chat: Column) -> Column:
    """Chat messages for a template without a system role: its text is put before the user's."""
    joined = F.concat(F.element_at(chat, 1)["content"], F.lit("\n\n"), F.element_at(chat, 2)["content"])
    return F.when(F.element_at(chat, 1)["role"] == "system", F.array(F.struct(F.lit("user").alias("role"), joined.alias("content")))).otherwise(chat)
