"""Accuracies, deltas, joint correctness tables and the aggregates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paravane.functions.text import percent

#: Names of the 8 cells: original, paraphrase, idiomatic, each right (T) or wrong (F).
CELLS = tuple(f"{o}{p}{i}" for o in "TF" for p in "TF" for i in "TF")


def rate(flag: Column) -> Column:
    """Share of true values; 0 for no rows."""
    return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))


def variant_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, unparseable rate and counts by key and variant, over all rows of the variant."""
    return predictions.groupBy(*keys, "variant").agg(
        rate(F.col("correct")).alias("accuracy"),
        rate(F.col("parse_status") == "unparseable").alias("unparseable_rate"),
        F.count("*").alias("n"),
        F.count_if(F.col("parse_status") == "unparseable").alias("n_unparseable"),
    )


def unparseable_ids(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each id that could not be parsed: a list would grow with the data."""
    return predictions.filter(F.col("parse_status") == "unparseable").select(*keys, "variant", "id")


def cells(triples: DataFrame, keys: list[str], total: str | None = None, where: Column | None = None) -> DataFrame:
    """Counts of the 8 joint outcomes as columns, with n: the sufficient statistic of every paired figure.

    With ``where`` only those triples count (the others' outcomes must be null), and ``total`` names
    a column that counts all.
    """
    o, p, i = F.col("original"), F.col("paraphrase"), F.col("idiomatic")
    counts = [F.count_if((o if c[0] == "T" else ~o) & (p if c[1] == "T" else ~p) & (i if c[2] == "T" else ~i)).alias(c) for c in CELLS]
    n = F.count("*") if where is None else F.count_if(where)
    return triples.groupBy(*keys).agg(n.alias("n"), *([F.count("*").alias(total)] if total else []), *counts)


def pooled(cells_: DataFrame, keys: list[str], over: str) -> DataFrame:
    """Per-key cells and, for each key without ``over``, their total ('pooled'), if there are two or more.

    Grouping sets: the cells are computed once and summed at both levels in one shuffle.
    """
    rest = [k for k in keys if k != over]
    sums = [F.sum(c).alias(c) for c in ("n", *CELLS)]
    both = cells_.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in rest]], *keys).agg(F.grouping(over).alias("__total"), F.count("*").alias("__rows"), *sums)
    kept = both.filter("__total = 0 OR __rows > 1").withColumn(over, F.when(F.col("__total") == 1, "pooled").otherwise(F.col(over)))
    return kept.select(*keys, "n", *CELLS)


def confusion(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """The 8 rows of each joint table: count and per cent, zero cells kept; most frequent first."""
    pairs = ", ".join(f"'{c}', {c}" for c in CELLS)
    rows = cells_.select(*keys, "n", F.expr(f"stack(8, {pairs}) as (cell, count)"))
    flags = [(F.substring("cell", k + 1, 1) == "T").alias(v) for k, v in enumerate(("original", "paraphrase", "idiomatic"))]
    return rows.select(*keys, *flags, "count", percent(F.col("count"), F.col("n")).alias("pct")).orderBy(*keys, F.desc("count"), F.desc("original"), F.desc("paraphrase"), F.desc("idiomatic"))


def sole_cause(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """Items that exactly one variant got wrong, by variant."""
    rows = cells_.select(*keys, "n", F.expr("stack(3, 'idiomatic_only_wrong', TTF, 'paraphrase_only_wrong', TFT, 'original_only_wrong', FTT) as (variant, count)"))
    return rows.select(*keys, "variant", "count", percent(F.col("count"), F.col("n")).alias("pct"))


def accuracies(cells_: DataFrame) -> DataFrame:
    """acc_original, acc_paraphrase, acc_idiomatic and the chained and naive deltas."""
    def share(place: int) -> Column:
        right = sum((F.col(c) for c in CELLS if c[place] == "T"), F.lit(0))
        return F.when(F.col("n") == 0, 0.0).otherwise(right / F.nullif(F.col("n"), F.lit(0)))

    out = cells_
    for place, name in enumerate(("original", "paraphrase", "idiomatic")):
        out = out.withColumn(f"acc_{name}", share(place))
    return (
        out.withColumn("delta_paraphrase", F.col("acc_paraphrase") - F.col("acc_original"))
        .withColumn("delta_idiom", F.col("acc_idiomatic") - F.col("acc_paraphrase"))
        .withColumn("delta_naive", F.col("acc_idiomatic") - F.col("acc_original"))
    )


#: Discordant counts (right before and wrong after, wrong before and right after) of each contrast.
DISCORDANT = {
    "paraphrase": (("TFT", "TFF"), ("FTT", "FTF")),
    "idiom": (("TTF", "FTF"), ("TFT", "FFT")),
    "naive": (("TTF", "TFF"), ("FTT", "FFT")),
}


def discordant(contrast: str) -> tuple[Column, Column]:
    lost, won = DISCORDANT[contrast]
    return sum((F.col(c) for c in lost), F.lit(0)), sum((F.col(c) for c in won), F.lit(0))


def parse_clean(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Triples whose three outputs were all parsed, with a row's correctness by variant."""
    from paravane.operators.align import triples

    both = predictions.withColumn("__v", F.struct("correct", "parse_status"))
    wide = triples(both, keys, "__v")
    names = ("original", "paraphrase", "idiomatic")
    ok = F.forall(F.array(*[F.col(f"{v}.parse_status") for v in names]), lambda s: s == "ok")
    return wide.withColumn("clean", ok).select(*keys, "clean", *[F.col(f"{v}.correct").alias(v) for v in names])


def validator_tally(rows: DataFrame, keys: list[str], validators: str = "validators") -> DataFrame:
    """Passes and failures by validator name, from a map column of structs with ``passed``."""
    each = rows.select(*keys, F.explode(validators).alias("name", "v"))
    return each.groupBy(*keys, "name").agg(F.count_if("v.passed").alias("passed"), F.count_if(~F.col("v.passed")).alias("failed"))
