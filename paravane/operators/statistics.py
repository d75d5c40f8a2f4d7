"""Paired tests, rank correlations and verdicts, as expressions over the joint cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions import special
from paravane.operators.metrics import discordant


#: Terms of the exact tail that are added up one by one; beyond, the incomplete beta function gives it.
SUMMED = 2_000


def exact_p(lost: Column, won: Column) -> Column:
    """Two-sided exact binomial p-value of the discordant counts; 1 if there are none.

    min(1, 2 * sum of C(n, k) / 2**n over k up to the smaller count).  Up to SUMMED terms are summed
    from logarithms, which do not underflow; for larger counts the same tail is the regularised
    incomplete beta function, so that no row holds a list that grows with the data.
    """
    n, least = (lost + won).cast("double"), F.least(lost, won).cast("long")
    start = F.struct((-n * F.lit(0.6931471805599453)).alias("term"), F.lit(0.0).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        return F.struct((acc["term"] + F.log((n - k) / (k + 1.0))).alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(least, F.lit(SUMMED).cast("long"))), start, add, lambda acc: acc["total"])
    tail = F.when(least <= SUMMED, summed).otherwise(special.half_tail_udf(least, (lost + won).cast("long")))
    return F.when(lost + won == 0, 1.0).when(lost == won, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def corrected_chi2(b: Column, c: Column) -> Column:
    """McNemar's statistic with continuity correction; 0 if nothing is discordant."""
    n = b + c
    return F.when(n == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1.0, F.lit(2.0)) / F.nullif(n, F.lit(0)))


def chi2_p(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, 1.0).otherwise(special.chi2_tail_udf(corrected_chi2(b, c)))


def mcnemar_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sole-cause counts b and c with the corrected statistic and its p-value."""
    b, c = F.col("TTF"), F.col("TFT")
    return cells.select(*keys, "n", b.alias("b"), c.alias("c"), F.col("FTT").alias("original_only"), corrected_chi2(b, c).alias("chi2"), chi2_p(b, c).alias("p_value"))


def with_exact_p(cells: DataFrame, **columns: str) -> DataFrame:
    """Adds exact p-values as expressions over the cells: ``with_exact_p(cells, naive_p="naive")``."""
    return cells.withColumns({name: exact_p(*discordant(contrast)) for name, contrast in columns.items()})


def exact_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exact p-values of the three contrasts."""
    names = {f"{c}_p": c for c in ("paraphrase", "idiom", "naive")}
    return with_exact_p(cells, **names).select(*keys, "n", *names)


def average_rank(column: str, partition: list[str]) -> Column:
    """Rank from 1, ties at the mean of their places."""
    ties = Window.partitionBy(*partition, column)
    return F.rank().over(Window.partitionBy(*partition).orderBy(column)) + (F.count("*").over(ties) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho by key, with n; the frame holds one row for each model, so windows are small."""
    ranked = df.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def with_spearman_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", special.spearman_p_udf("rho", "n"))


def leaning(b: Column, c: Column) -> Column:
    """Which variant is the sole cause of more mistakes."""
    return F.when(b > c, "idiomatic").when(c > b, "paraphrase").otherwise("TIE")


def significance(p: Column, low: Column, high: Column, alpha: float = 0.05) -> list[Column]:
    """Whether the test and the interval call a difference, and whether they agree."""
    test, interval = p < alpha, (low > 0) | (high < 0)
    return [test.alias("test_significant"), interval.alias("interval_significant"), (test == interval).alias("agree")]


def resolved(low: str, high: str) -> Column:
    """An interval that lies strictly on one side of 0."""
    return (F.col(low) > 0) | (F.col(high) < 0)


def error_bars(point: str, low: str, high: str) -> list[Column]:
    return [(F.col(high) - F.col(point)).alias(f"{point}_plus"), (F.col(point) - F.col(low)).alias(f"{point}_minus")]
