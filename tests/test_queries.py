"""Every registered engine query against DuckDB on the smallest tables."""

import decimal
import math
import os

import duckdb
import numpy as np
import pytest

from paravane import queries as engine
from paravane.operators import bootstrap, metrics, statistics
from paravane.plans import q_figures

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: str(float(v)) if isinstance(v, (float, decimal.Decimal)) else str(v)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


def cells(spark):
    return {(r["dataset"], r["model_id"]): r for r in metrics.pooled(q_figures.cells_of(spark, SF), q_figures.KEYS, "model_id").collect()}


def counted(row):
    return np.array([row[c] for c in metrics.CELLS], float)


def row_bootstrap(row, statistic, resamples=2000):
    """Draws rows one by one, as the definition says."""
    table = counted(row)
    of = np.repeat(np.arange(8), table.astype(int))
    rng = np.random.default_rng(5)
    picked = of[rng.integers(0, len(of), (resamples, len(of)))]
    return np.array([statistic(np.bincount(p, minlength=8)) for p in picked])


def near(got, want, table, wide=0.15):
    """An interval's ends up to Monte Carlo noise: a share of its width."""
    low, high = np.percentile(want, [2.5, 97.5])
    assert abs(got[0] - low) <= wide * (high - low) + 1e-9 + table and abs(got[1] - high) <= wide * (high - low) + 1e-9 + table


def check_chi2_p(spark, rows):
    of = cells(spark)
    for r in rows:
        b, c = (of[r["dataset"], r["model_id"]][k] for k in ("TTF", "TFT"))
        chi2 = 0.0 if b + c == 0 else (abs(b - c) - 1) ** 2 / (b + c)
        assert r["p_value"] == pytest.approx(1.0 if b + c == 0 else math.erfc(math.sqrt(chi2 / 2)), abs=1e-9)


def check_difference(spark, rows):
    of = cells(spark)
    for r in rows:
        row = of[r["dataset"], r["model_id"]]
        assert r["observed_diff"] == row["TTF"] - row["TFT"] and 0 <= r["p_value"] <= 1
        near((r["ci_low"], r["ci_high"]), row_bootstrap(row, lambda t: t @ bootstrap.DIFFERENCE), 1.0)


def check_paired(spark, rows):
    of = cells(spark)
    for r in rows:
        row = of[r["dataset"], r["model_id"]]
        n = counted(row).sum()
        right = bootstrap.RIGHT
        for name, v in (("acc_original", right["original"]), ("delta_idiom", right["idiomatic"] - right["paraphrase"]), ("delta_paraphrase", right["paraphrase"] - right["original"])):
            assert r[name] == pytest.approx(counted(row) @ v / n)
            if f"{name}_ci_low" in r.asDict():  # the summary has no intervals of the accuracies
                near((r[f"{name}_ci_low"], r[f"{name}_ci_high"]), row_bootstrap(row, lambda t, v=v: t @ v / n), 1.0 / n)


def check_significant(spark, rows):
    every = q_figures.a15_summary(spark, SF).collect()
    apart = lambda r, d: r[f"{d}_ci_low"] > 0 or r[f"{d}_ci_high"] < 0
    want = {(r["dataset"], r["model_id"]) for r in every if apart(r, "delta_idiom") or apart(r, "delta_paraphrase")}
    assert {(r["dataset"], r["model_id"]) for r in rows} == want


def check_agreement(spark, rows):
    chi2 = {(r["dataset"], r["model_id"]): r["p_value"] for r in statistics.mcnemar_table(q_figures.cells_of(spark, SF), q_figures.KEYS).collect()}
    boot = {(r["dataset"], r["model_id"]): r["p_value"] for r in bootstrap.difference_table(q_figures.cells_of(spark, SF), q_figures.KEYS).collect()}
    assert [tuple(r) for r in rows] == [(len(chi2), sum((chi2[k] < 0.05) != (boot[k] < 0.05) for k in chi2))]


def t_tail(t, df, steps=200_000):
    """P(|T| >= t) by summing the density."""
    x = np.linspace(0, t, steps)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(density, x)


def check_trend_p(spark, rows):
    for r in rows:
        for rho, p in ((r["rho_acc"], r["p_acc"]), (r["rho_params"], r["p_params"])):
            if abs(rho) < 1:
                assert p == pytest.approx(t_tail(abs(rho) * math.sqrt((r["n"] - 2) / (1 - rho * rho)), r["n"] - 2), abs=1e-6)


def check_floor(spark, rows):
    for r in rows:
        rho, n = r["rho"], r["n"]
        assert t_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2) == pytest.approx(0.05, abs=1e-6)


#: What is checked of the queries that SQL cannot express.
CHECKS = {
    "a15_summary": check_paired,
    "a16_cross_model": check_paired,
    "a17_cross_dataset_significant": check_significant,
    "a19_test_agreement": check_agreement,
    "m2_chi2_p": check_chi2_p,
    "m3_bootstrap_difference": check_difference,
    "m4_paired_bootstrap": check_paired,
    "m5_trend_p": check_trend_p,
    "m6_detection_floor": check_floor,
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, db, name):
    df = engine.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = engine.oracle_sql().get(name)
    if sql is None:
        CHECKS[name](spark, df.collect())  # a query with neither SQL nor a check of its own fails
        return
    c = db.execute(sql)
    assert got == canonical([d[0] for d in c.description], c.fetchall())
