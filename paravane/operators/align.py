"""Alignment of parallel versions: triples, reconciliation, resume, cache and replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paravane.schemas import VARIANTS


class MissingRows(ValueError):
    """A join that must be complete was not."""


def unique_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself, or an error at run time for a key that occurs twice (joins would fan out)."""
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.any_value(c, ignoreNulls=True).alias(c) for c in df.columns if c not in keys])
    guard = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("key occurs more than once: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
    return one.filter(guard).select(*df.columns)


def last_per_id(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in file order: what a lookup by key keeps."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def wide(predictions: DataFrame, keys: list[str], value: str, variants: tuple[str, ...]) -> DataFrame:
    """One row for each key and one column for each variant, null where there is none.

    Conditional aggregates need one shuffle on the keys, with a partial aggregation before it; a
    pivot would first shuffle on the keys with the variant.  Of several rows of a key and variant
    the last one (by ``row_idx``, where there is such a column) counts.
    """
    if "row_idx" in predictions.columns:
        columns = [F.max_by(value, F.when(F.col("variant") == v, F.col("row_idx"))).alias(v) for v in variants]
    else:
        columns = [F.any_value(F.when(F.col("variant") == v, F.col(value)), ignoreNulls=True).alias(v) for v in variants]
    return predictions.groupBy(*keys).agg(*columns)


def triples(predictions: DataFrame, keys: list[str], value: str = "correct", variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """One row for each key, one column for each variant; keys that lack a variant are dropped."""
    return wide(predictions, keys, value, variants).dropna(subset=list(variants))


def require_triples(predictions: DataFrame, keys: list[str], value: str = "correct", variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """As ``triples``, but a key without all variants is an error instead of being dropped."""
    rows = wide(predictions, keys, value, variants)
    lacking = F.array_compact(F.array(*[F.when(F.col(v).isNull(), F.lit(v)) for v in variants]))
    guard = F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("missing variants "), F.array_join(lacking, ", "), F.lit(" for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
    return rows.filter(guard)


def with_labels(df: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Left lookup of y by key, '' where there is none."""
    return df.join(labels.select(key, F.col("y").alias("__y")), key, "left").withColumn("y", F.coalesce("__y", F.lit(""))).drop("__y")


def common_ids(rows: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """Ids that every one of the variants has."""
    return rows.filter(F.col("variant").isin(*variants)).groupBy("id").agg(F.count_distinct("variant").alias("n")).filter(F.col("n") == len(variants)).select("id")


def reconcile(rows: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """The rows of the variants, reduced to their common ids."""
    return rows.filter(F.col("variant").isin(*variants)).join(common_ids(rows, variants), "id", "left_semi")


def removed_ids(rows: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """(id, variant) rows that reconciliation removes."""
    return rows.filter(F.col("variant").isin(*variants)).select("id", "variant").join(common_ids(rows, variants), "id", "left_anti")


def unaligned_skips(rows: DataFrame, known: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """New 'unaligned' entries for the skip manifest: removed rows that it does not list yet."""
    new = removed_ids(rows, variants).join(known.select("id", "variant"), ["id", "variant"], "left_anti")
    return new.select("id", "variant", F.lit("unaligned").alias("reason"), F.array().cast("array<string>").alias("failing"), F.lit(0).alias("attempts"))


def remaining(rows: DataFrame, done: DataFrame, skipped: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows that are neither done nor skipped."""
    known = done.select(key) if skipped is None else done.select(key).union(skipped.select(key))
    return rows.join(known, key, "left_anti")


def resumable(existing: DataFrame, augmenter_model: str, prompt_hash: str) -> DataFrame:
    """Stored rows of the same model and prompt; rows of another one are stale as a whole."""
    same = (F.col("augmenter_model") == augmenter_model) & (F.col("prompt_hash") == prompt_hash)
    return existing.filter(same)


def cache_key(prompt_hash: Column, model: Column, id_: Column) -> Column:
    return F.sha2(F.concat_ws("\x1e", prompt_hash, model, id_), 256)


def with_cache(rows: DataFrame, cache: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Left lookup of cached responses by (prompt_hash, augmenter_model, id); ``hit`` tells which were found.

    ``carry`` names more columns of the cache that come along.
    """
    keys = ["prompt_hash", "augmenter_model", "id"]
    return rows.join(cache.select(*keys, F.col("response").alias("cached"), *carry), keys, "left").withColumn("hit", F.col("cached").isNotNull())


def cache_stats(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def merge_resumed(examples: DataFrame, checkpoint: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Checkpointed and new predictions, new ones first, for the examples that have either; in example order."""
    own = [c for c in new.columns if c != key]
    old = checkpoint.select(key, F.struct(*own).alias("__old"))
    fresh = new.select(key, F.struct(*own).alias("__new"))
    both = old.join(fresh, key, "full").select(key, F.coalesce("__new", "__old").alias("__p"))
    return examples.select(key, "row_idx").join(both, key).select(key, "row_idx", "__p.*")


def replayed(examples: DataFrame, prior: DataFrame, key: str = "id") -> DataFrame:
    """Stored raw outputs joined to the examples; an example without one is an error."""
    joined = examples.join(prior.select(key, F.col("raw").alias("__raw")), key, "left")
    guard = F.when(F.col("__raw").isNull(), F.raise_error(F.concat(F.lit("no stored output for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return joined.filter(guard).withColumnRenamed("__raw", "raw")


def agreement(left: DataFrame, right: DataFrame, keys: list[str], pairs: dict[str, str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Inner merge on the keys and, per pair of columns, whether all values are close."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    close = [F.coalesce(F.bool_and(F.abs(F.col(f"a.{x}") - F.col(f"b.{y}")) <= atol + rtol * F.abs(F.col(f"b.{y}"))), F.lit(True)).alias(f"{x}_agrees") for x, y in pairs.items()]
    return joined.agg(F.count("*").alias("n"), *close)


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: empty if the key sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
