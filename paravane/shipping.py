"""Sends the engine's own modules to the executors, whose Python may not find them otherwise."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package (and the top-level pipeline, where present) to the workers' path, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="paravane-")) / "paravane-modules.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted([*ROOT.glob("paravane/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(path, path.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
