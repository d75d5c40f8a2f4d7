"""Paired bootstrap from the joint cells, and a counter-based resampler.

Resampling n rows with replacement draws the 8 cell counts from a multinomial
with probabilities cells / n.  Every statistic here depends on the cells only,
so ``resamples`` draws for a group cost 8 * resamples numbers, whatever n is:
no row is shuffled and no n * resamples matrix exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paravane.operators.metrics import CELLS

RIGHT = {name: np.array([c[k] == "T" for c in CELLS], float) for k, name in enumerate(("original", "paraphrase", "idiomatic"))}
DIFFERENCE = np.array([float(c == "TTF") - float(c == "TFT") for c in CELLS])


def draws(cells: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """(resamples, 8) cell counts of resampled tables."""
    n = int(cells.sum())
    return np.random.Generator(np.random.PCG64(seed)).multinomial(n, cells / n, size=resamples)


def difference_interval(cells: np.ndarray, resamples: int = 10_000, seed: int = 0) -> tuple[int, float, float, float]:
    """Sole-cause difference, its 95 % percentile interval and two-sided empirical p-value."""
    if not cells.sum():
        return 0, 0.0, 0.0, 1.0
    observed = int(cells @ DIFFERENCE)
    sampled = draws(cells, resamples, seed) @ DIFFERENCE
    opposite = (sampled <= 0).sum() if observed >= 0 else (sampled >= 0).sum()
    low, high = np.percentile(sampled, [2.5, 97.5])
    return observed, float(low), float(high), float(min(1.0, 2 * opposite / resamples))


def difference_table(cells: DataFrame, keys: list[str], resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """One row by key: observed_diff, ci_low, ci_high, p_value, n_boot."""
    types = dict(cells.dtypes)

    def run(batches):
        for pdf in batches:
            rows = [difference_interval(r, resamples, seed) for r in pdf[list(CELLS)].to_numpy(np.int64)]
            found = pd.DataFrame(rows, columns=["observed_diff", "ci_low", "ci_high", "p_value"])
            yield pd.concat([pdf[keys].reset_index(drop=True), found.assign(n_boot=resamples)], axis=1)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return cells.select(*keys, *CELLS).mapInPandas(run, f"{schema}, observed_diff long, ci_low double, ci_high double, p_value double, n_boot long")


def paired_intervals(cells: np.ndarray, resamples: int, level: float, seed: int) -> dict[str, tuple[float, float, float]]:
    """Point and percentile interval of the three accuracies and two chained deltas, from shared resamples."""
    n = cells.sum()
    if not n:
        raise ValueError("no rows to resample")
    sampled = draws(cells, resamples, seed) / n
    share = {k: (cells @ v / n, sampled @ v) for k, v in RIGHT.items()}
    values = {f"acc_{k}": v for k, v in share.items()}
    values["delta_paraphrase"] = tuple(share["paraphrase"][i] - share["original"][i] for i in (0, 1))
    values["delta_idiom"] = tuple(share["idiomatic"][i] - share["paraphrase"][i] for i in (0, 1))
    tails = [50 * (1 - level), 50 * (1 + level)]
    return {k: (float(point), *map(float, np.percentile(s, tails))) for k, (point, s) in values.items()}


ESTIMATES = ("acc_original", "acc_paraphrase", "acc_idiomatic", "delta_paraphrase", "delta_idiom")


def paired_table(cells: DataFrame, keys: list[str], resamples: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row by key: point, low and high of each estimate."""
    types = dict(cells.dtypes)
    names = [f"{e}{end}" for e in ESTIMATES for end in ("", "_ci_low", "_ci_high")]

    def run(batches):
        for pdf in batches:
            rows = [[v for e in ESTIMATES for v in found[e]] for found in (paired_intervals(r, resamples, level, seed) for r in pdf[list(CELLS)].to_numpy(np.int64))]
            yield pd.concat([pdf[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return cells.select(*keys, "n", *CELLS).mapInPandas(run, f"{schema}, n long, " + ", ".join(f"{c} double" for c in names))


def counter_bootstrap(rows: DataFrame, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """Mean of ``value`` in each resample, drawn by a counter-based generator.

    ``rows`` has a contiguous place ``j`` from 0.  Draw (b, j) takes the row at
    md5(seed|b|j) modulo n, so any engine draws the same rows.  Meant for small
    tables (n * resamples draws are made); use the cells for large ones.
    """
    n = rows.agg(F.count("*").alias("n"))
    picks = rows.select("j").crossJoin(F.broadcast(n)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = picks.select("b", place.alias("j")).join(rows.select("j", value), "j")
    return drawn.groupBy("b").agg(F.avg(value).alias("mean"))
