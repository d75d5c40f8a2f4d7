"""Writers: variant CSVs, sidecars, tables, figures' data and reports.

Big tables are written by Spark; small reports are rendered on the driver from
rows that have been aggregated already.
"""

from __future__ import annotations

import html
import json
import os
import platform
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane import schemas
from paravane.schemas import VARIANT_COLUMNS, VARIANTS
from paravane.sources import paths
from paravane.sources.variants import CSV


class Exists(FileExistsError):
    """The target exists and overwriting was not asked for."""


def guard(path: str | Path, force: bool, spark: SparkSession | None = None) -> None:
    """An error if the target exists and may not be overwritten; with a session, in any store that it reads."""
    there = paths.exists(spark, str(path)) if spark else Path(path).exists()
    if there and not force:
        raise Exists(f"{path} exists; pass force to overwrite it")


def write_rows(df: DataFrame, path: str, force: bool = False) -> None:
    """Variant rows as CSV that any RFC 4180 reader reads back byte by byte."""
    options = {k: v for k, v in CSV.items() if k not in ("multiLine", "nullValue")}
    df.select(*VARIANT_COLUMNS).na.fill("").write.mode("overwrite" if force else "errorifexists").options(**options).csv(path)


def with_validators_json(df: DataFrame) -> DataFrame:
    """The validators map as JSON with its names in order."""
    names = F.array_sort(F.map_keys("validators"))
    ordered = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at("validators", n)))
    return df.withColumn("validators", F.to_json(ordered, {"ignoreNullFields": "false"}))


def replace_rows(df: DataFrame, path: str) -> None:
    """Variant rows in the place of older ones, from which they may be computed: written beside them, then renamed."""
    draft = f"{path}.draft"
    write_rows(df, draft, True)
    paths.replace(df.sparkSession, draft, path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Progress of a session: one atomic append of Parquet files."""
    df.write.mode("append").parquet(path)


def append_cache(df: DataFrame, path: str, enabled: bool = True) -> None:
    """Cached responses and, where there are any, their verdicts; nothing happens while the cache is off."""
    if enabled:
        verdicts = [F.from_json("validators", schemas.VALIDATORS).alias("validators")] if "validators" in df.columns else []
        record = F.to_json(F.struct(F.col("response").alias("x"), *verdicts), {"ignoreNullFields": "false"}) if verdicts else F.to_json(F.struct(F.col("response").alias("x")))
        df.select("prompt_hash", "augmenter_model", "id", record.alias("record")).write.mode("append").parquet(path)


def write_skips(df: DataFrame, path: str) -> None:
    """The skip manifest, in id order, as one JSON record a line; written beside the old one, then renamed."""
    df.orderBy("id", "variant").write.mode("overwrite").json(f"{path}.draft")
    paths.replace(df.sparkSession, f"{path}.draft", path)


def atomic_text(path: str | Path, text: str) -> None:
    """Write beside the target, then rename: readers see the old file or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(f".{target.name}.part")
    draft.write_text(text, encoding="utf-8")
    os.replace(draft, target)


def json_text(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_json(path: str | Path, value: dict, force: bool = True) -> None:
    guard(path, force)
    atomic_text(path, json_text(value))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes: beside the target, then renamed."""
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = store.getFileSystem(spark._jsc.hadoopConfiguration()).create(store, True)
    out.write(bytearray(text.encode()))
    out.close()
    paths.replace(spark, f"{path}.part", path)


def sidecar(stage: str, config: dict, counts: dict, **more) -> dict:
    """What produced a file: configuration, counts and tool versions."""
    return {"stage": stage, "resolved_config": config, "row_counts": counts, "tool_versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}, "timestamp_utc": datetime.now(UTC).isoformat().replace("+00:00", "Z"), **more}


def provenance(runs: DataFrame) -> dict:
    """Sources of a table by 'dataset/model': one entry for each run."""
    rows = runs.select("dataset", "model_id", "model_revision", "config_hash", "prompt_hash").distinct().collect()
    return {f"{r['dataset']}/{r['model_id']}": {k: r[k] for k in ("model_revision", "config_hash", "prompt_hash")} for r in rows}


def cell(value) -> str:
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v).replace("|", "\\|") for v in r) + " |" for r in rows]) + "\n"


def write_table(df: DataFrame, folder: str | Path, name: str, force: bool = False) -> None:
    """A small table as name.csv and name.md."""
    rows = [tuple(r) for r in df.collect()]
    for suffix in ("csv", "md"):
        guard(Path(folder) / f"{name}.{suffix}", force)
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v
    text = "\n".join(",".join(quote("" if v is None else str(v)) for v in r) for r in [tuple(df.columns), *rows]) + "\n"
    atomic_text(Path(folder) / f"{name}.csv", text)
    atomic_text(Path(folder) / f"{name}.md", markdown(df.columns, rows))


def points(value: float | None, bold: bool = False, mark: bool = False) -> str:
    """A delta in percentage points for LaTeX; --- if it is missing."""
    if value is None:
        return "---"
    text = f"{100 * value:+.2f}".replace("-", "$-$")
    return (rf"\textbf{{{text}}}" if bold else text) + (r"$^{\dagger}$" if mark else "")


def latex_summary(rows: Sequence[dict]) -> str:
    """The dataset-level table."""
    body = [" & ".join([r["dataset"], str(r["models"]), points(r["mean_delta_paraphrase"]), points(r["mean_delta_idiom"]), f"{r['sig_neg']} / {r['sig_pos']}"]) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{lrrrr}", *body, r"\end{tabular}"]) + "\n"


def latex_panels(models: Sequence[str], names: dict[str, str], deltas: dict[tuple[str, str], tuple[float, float]], datasets: Sequence[str], alpha: float = 0.05) -> str:
    """The per-model table in two panels side by side; an odd count leaves the last cell empty."""
    def line(model: str | None) -> str:
        if model is None:
            return " & ".join([""] * (1 + len(datasets)))
        cells = []
        for ds in datasets:
            delta, p = deltas.get((ds, model), (None, 1.0))
            cells.append(points(delta, bold=p < alpha, mark=delta is not None and p < alpha and delta > 0))
        return " & ".join([names.get(model, model), *cells])

    half = -(-len(models) // 2)
    left, right = list(models[:half]), [*models[half:], *[None] * (2 * half - len(models))]
    body = [f"{line(a)} & {line(b)} " + r"\\" for a, b in zip(left, right)]
    return "\n".join([r"\begin{tabular}{" + "l" + "r" * len(datasets) + "l" + "r" * len(datasets) + "}", *body, r"\end{tabular}"]) + "\n"


def verdict_text(b: int, c: int, chi2: float, p: float, low: float, high: float, alpha: float = 0.05) -> str:
    """The decision in words; where the tests disagree the non-significant verdict is preferred."""
    lead = "the idiomatic version" if b > c else "the paraphrase" if c > b else "neither version"
    by_test, by_interval = p < alpha, low > 0 or high < 0
    if by_test and by_interval:
        end = f"{lead} is the sole cause of more mistakes, and both tests call the difference significant"
    elif by_test or by_interval:
        end = "the two tests disagree; the non-significant verdict is to be preferred"
    else:
        end = "neither test calls the difference significant"
    return f"b = {b}, c = {c}, χ² = {chi2:.3f}, p = {p:.5f}, 95 % interval [{low:g}, {high:g}]: {end}."


def axis_of(rows: Sequence[tuple[str, float, float, float]]) -> tuple[float, float]:
    """Ends of an axis that holds all intervals and 0, with a margin of 6 %."""
    low, high = min([0.0, *(r[2] for r in rows)]), max([0.0, *(r[3] for r in rows)])
    pad = 0.06 * (high - low or 1.0)
    return low - pad, high + pad


def drawing(rows: Sequence[tuple[str, float, float, float]], axis: tuple[float, float], width: int = 640, colours: Sequence[str] = ("#88a",)) -> str:
    """An SVG of a bar with its interval for each (label, point, low, high)."""
    low, high = axis
    x = lambda v: width * (v - low) / (high - low)
    parts = []
    for k, (label, point, a, b) in enumerate(rows):
        y, colour = 24 * k + 12, colours[k % len(colours)]
        parts.append(f'<rect x="{min(x(0), x(point)):.1f}" y="{y - 7}" width="{abs(x(point) - x(0)):.1f}" height="14" fill="{colour}"/><line x1="{x(a):.1f}" x2="{x(b):.1f}" y1="{y}" y2="{y}" stroke="#222"/><text x="{width + 8}" y="{y + 4}">{html.escape(label)}</text>')
    return f'<svg width="{width + 300}" height="{24 * len(rows)}">{"".join(parts)}</svg>'


def page(title: str, body: str) -> str:
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}\n'


def bars(title: str, rows: Sequence[tuple[str, float, float, float]], width: int = 640) -> str:
    """A figure as a small HTML page: a bar with its interval for each (label, point, low, high)."""
    return page(title, drawing(rows, axis_of(rows), width))


def panels(title: str, parts: dict[str, Sequence[tuple[str, float, float, float]]], shared: bool = False) -> str:
    """A figure of several panels; with ``shared`` all of them have one axis."""
    axis = axis_of([r for rows in parts.values() for r in rows]) if shared else None
    return page(title, "".join(f"<h2>{html.escape(name)}</h2>{drawing(rows, axis or axis_of(rows), 480, ('#88a', '#a86', '#6a8') if name == 'accuracy' else ('#a86', '#6a8'))}" for name, rows in parts.items()))


def dataset_figure(dataset: str, table: Sequence[dict]) -> str:
    """A dataset's models in plotting order: the accuracies of the three variants, and the two chained deltas."""
    interval = lambda r, label, c: (f"{r['model_id']} {label}", r[c], r[f"{c}_ci_low"], r[f"{c}_ci_high"])
    accuracy = [interval(r, v, f"acc_{v}") for r in table for v in VARIANTS]
    deltas = [interval(r, label, c) for r in table for label, c in (("paraphrase - original", "delta_paraphrase"), ("idiomatic - paraphrase", "delta_idiom"))]
    return panels(dataset, {"accuracy": accuracy, "deltas": deltas})


def facets_figure(table: Sequence[dict]) -> str:
    """The idiom deltas of all datasets side by side, on one axis; models by falling mean delta."""
    mean: dict[str, list[float]] = {}
    for r in table:
        mean.setdefault(r["model_id"], []).append(r["delta_idiom"])
    order = sorted(mean, key=lambda m: (-sum(mean[m]) / len(mean[m]), m))
    parts = {}
    for ds in sorted({r["dataset"] for r in table}):
        own = {r["model_id"]: r for r in table if r["dataset"] == ds}
        parts[ds] = [(f"{m} {name}", own[m][c], own[m][f"{c}_ci_low"], own[m][f"{c}_ci_high"]) for m in order if m in own for name, c in (("paraphrase", "delta_paraphrase"), ("idiomatic", "delta_idiom"))]
    return panels("deltas by dataset", parts, shared=True)


def confusion_figure(title: str, cells: Sequence[dict], causes: Sequence[dict]) -> str:
    """The joint outcomes of a run as a table, and the bars of what alone went wrong."""
    mark = lambda right: "right" if right else "wrong"
    lines = "".join(f"<tr>{''.join(f'<td>{mark(r[v])}</td>' for v in VARIANTS)}<td>{r['count']}</td><td>{r['pct']:.2f}</td></tr>" for r in cells)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in (*VARIANTS, "tasks", "%"))
    rows = [(f"only {r['variant']}", float(r["pct"]), float(r["pct"]), float(r["pct"])) for r in causes]
    return page(title, f"<table border=1><tr>{head}</tr>{lines}</table><h2>wrong alone, % of tasks</h2>{drawing(rows, axis_of(rows))}")


def confusion_report(title: str, n: int, b: int, c: int, chi2: float, p: float, low: float, high: float, boot_p: float, resamples: int, alpha: float = 0.05) -> str:
    """The paired comparison of the two rewrites in words: the verdict, then how it came about."""
    share = lambda k: f"{100 * k / n:.2f} %" if n else "0 %"
    more = "idiomatic" if b > c else "paraphrase" if c > b else "neither"
    return "\n".join(
        [
            verdict_text(b, c, chi2, p, low, high, alpha),
            "",
            f"# {title}",
            "",
            "## Question",
            "",
            "Does the idiomatic version of a task make the model fail where its neutral rewrite does not, more often than the other way round?",
            f"All {n} aligned tasks count; an output that could not be read counts as wrong.",
            "",
            "## Counts",
            "",
            markdown(["what alone went wrong", "tasks", "share"], [["idiomatic (b)", b, share(b)], ["paraphrase (c)", c, share(c)]]),
            f"Larger: {more}. Tasks on which both rewrites agree say nothing about the difference.",
            "",
            "## Corrected test",
            "",
            f"(|b - c| - 1)² / (b + c) = {chi2:.3f}, one degree of freedom, p = {p:.5f}." if b + c else "No task tells the rewrites apart; p = 1.",
            f"At {alpha:g} this is {'significant' if p < alpha else 'not significant'}.",
            "",
            "## Bootstrap",
            "",
            f"b - c = {b - c}; {resamples} resamples of the {n} tasks give a 95 % interval of [{low:g}, {high:g}] and an empirical p of {boot_p:.4f}.",
            f"The interval {'lies on one side of' if low > 0 or high < 0 else 'holds'} 0.",
            "",
            "## Decision",
            "",
            "A difference is called significant only if the test and the interval both call it so; otherwise the verdict is that none was shown.",
            "",
        ]
    )
