"""Cleaning: length band, keep-first dedupe, seeded order and cap, with step counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions import text as T


@dataclass(frozen=True)
class CleanOptions:
    """What a cleaning run does; ``max_rows`` None means no cap."""

    normalize: tuple[str, ...] = ("nfc", "collapse_whitespace")
    min_words: int = 10
    max_words: int = 100
    dedupe: bool = True
    seed: int = 0
    max_rows: int | None = None


@dataclass
class StepCounts:
    """Rows after each step; filled when the cleaned table is first written or counted."""

    values: dict[str, int] = field(default_factory=dict)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order (``dropDuplicates`` would keep any).

    The aggregate form combines before the shuffle, so a key that holds a large share of all rows
    does not gather its rows in one task, as a window would.  Rows are sorted and dealt by the key's
    digest where it holds texts, which may be long.
    """
    first = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    texts = any(dict(df.dtypes)[k] == "string" for k in keys)
    by = [F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256).alias("__key")] if texts else keys
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), first).alias("__row")).select("__row.*")


def in_band(least: int, most: int, text: str = "x") -> Column:
    """Whether a text's word count lies within the inclusive band.

    No normalizer changes the number of words, so this can be asked of the raw text: a built-in
    expression that is filtered on before any Python runs.
    """
    return T.word_count(T.collapse_whitespace(F.col(text))).between(least, most)


def seeded_key(seed: int, *columns: str) -> Column:
    """A shuffle key that depends on the seed and the row only, not on partitions."""
    return F.sha2(F.concat_ws(T.SEPARATOR, F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def seeded_order(df: DataFrame, seed: int, columns: list[str], cap: int | None = None) -> DataFrame:
    """Rows in seeded order, the first ``cap`` of them; with a cap only the head is gathered."""
    ordered = df.orderBy(seeded_key(seed, *columns), *columns)
    return ordered if cap is None else ordered.limit(cap)


def clean(tasks: DataFrame, options: CleanOptions, order: str = "row_idx") -> DataFrame:
    """length band and normalisation -> keep-first dedupe on (x, meta, y) -> seeded order -> cap, as one plan."""
    df = tasks.filter(in_band(options.min_words, options.max_words)).withColumn("x", T.normalize(options.normalize, F.col("x")))
    if options.dedupe:
        df = keep_first(df, ["x", "meta", "y"], [order])
    return seeded_order(df, options.seed, ["id", order], options.max_rows)


def step_counts(tasks: DataFrame, options: CleanOptions) -> DataFrame:
    """One row: rows after every step, from a single pass and one aggregation.

    Distinct (x, meta, y) keys are counted with the band as a condition, so no step is run twice;
    they are shuffled as digests, not as texts.
    """
    df = tasks.withColumn("inside", in_band(options.min_words, options.max_words)).withColumn("x", T.normalize(options.normalize, F.col("x")))
    digest = F.sha2(F.to_json(F.struct("x", "meta", "y"), {"ignoreNullFields": "false"}), 256)
    by_key = df.groupBy(digest.alias("key")).agg(F.count("*").alias("n"), F.count_if("inside").alias("kept"))
    once = F.count_if(F.col("kept") > 0) if options.dedupe else F.sum("kept")
    counts = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_loaded"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("after_normalize"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("after_length_filter"),
        F.coalesce(once, F.lit(0)).alias("after_dedupe"),
    )
    final = F.col("after_dedupe") if options.max_rows is None else F.least("after_dedupe", F.lit(options.max_rows))
    return counts.withColumn("after_shuffle_and_cap", final).withColumn("written", final)
