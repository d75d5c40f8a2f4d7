"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, never reach an operator.

    Without a text column the key is a struct, and the text is its field ``text``: whole rows can
    then travel as the key, and their texts are sent once.
    """
    key = F.col(id_col).alias("doc_id")
    return df.select(key) if text_col is None else df.select(key, F.col(text_col).alias("text"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a (doc_id, text) batch, or of its keys."""
    if "text" in batch.schema.names:
        return batch.column("text")
    key = batch.column("doc_id")
    return pc.struct_field(key, key.type.get_field_index("text"))


def without_repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop rows of equal id and text but the first that this task sees.

    For operators that count rows of equal id as one document: however often a row is repeated, each
    task passes it on once.
    """
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for i, row in enumerate(zip(batch.column("doc_id").to_pylist(), map(hash, text_of(batch).to_pylist()))):
            if row not in seen:
                seen.add(row)
                keep.append(i)
        yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def release() -> None:
    """Give freed memory back to the system: workers live on and share a small budget."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` that keeps a worker's memory small: plain allocation, freed memory returned after each task."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        release()

    return df.mapInArrow(framed, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, for rows that may be long."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session (tests, notebooks) may go without that setting; it gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Checkpoint files of the work in hand, while ``passing`` collects them.
_passing: list[list[str]] = []


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    if _passing:
        plan = out._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if hasattr(plan, "rdd") else None
        if file is not None and file.isDefined():
            _passing[-1].append(file.get())
    return out


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a table that has been read for the last time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Frames that are settled inside are of no use after it: their files are removed at its end.

    What ``retain`` takes off the list that it yields stays.
    """
    files: list[str] = []
    _passing.append(files)
    try:
        yield files
    finally:
        _passing.pop()
        for file in files:
            discard(spark, file)


def retain(files: list[str]) -> None:
    """Keep the frames settled so far beyond the innermost ``passing``, whose list this is."""
    if len(_passing) > 1:
        _passing[-2].extend(files)
    files.clear()


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        sizes = pc.fill_null(pc.binary_length(text_of(batch)), 0).to_pylist()
        start, held = 0, 0
        for i in range(n):
            held += sizes[i]
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < n:
            yield batch.slice(start, n - start)


#: Rows and bytes that are broadcast at most; a longer or wider list is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def fit_to_send(rows: DataFrame) -> DataFrame:
    """A settled frame, marked for broadcast if it was measured to be small enough.

    Its rows are counted first; only a short frame's bytes are added up (as text, which is no
    shorter than the rows themselves).
    """
    rows = settle(rows)
    if rows.count() > BROADCAST_ROWS:
        return rows
    size = rows.agg(F.sum(F.length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


#: Labelled documents that a classifier may be fitted on at most: those whose hashed id is smallest.
LABEL_ROWS = 6_000


def bounded_sample(docs: DataFrame, rated: DataFrame, name: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` ids: those of (doc_id, label) whose hash is smallest.

    An id that occurs more than once counts once, with its least label and text, so that the bound
    holds however often an id is repeated.
    """
    once = rated.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy("doc_id").agg(F.min(name).alias(name))
    few = F.broadcast(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # that many rows at most
    return few.join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min(name).alias(name))


def labelled(docs: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """A bounded sample of (doc_id, text, label) outside the held-out fold (crc32 of the id, modulo 4, is 2)."""
    return bounded_sample(docs, labels.filter(fold("doc_id", 4) != 2).select("doc_id", F.col(column).alias(name)), name, LABEL_ROWS)
