"""Files and folders through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _open(spark, path)
    return store.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, at = _open(spark, path)
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    store, at = _open(spark, path)
    store.delete(at, True)


def replace(spark: SparkSession, draft: str, target: str) -> None:
    """Put a finished draft in the target's place; what the target held may have been read to make it."""
    store, at = _open(spark, target)
    store.delete(at, True)
    if not store.rename(_open(spark, draft)[1], at):
        raise OSError(f"{draft} could not be renamed to {target}")


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a file or folder, by name."""
    store, at = _open(spark, path)
    status = store.getFileStatus(at)
    if not status.isDirectory():
        return [status.getPath().toString()]
    found = [s.getPath() for s in store.listStatus(at) if s.isFile()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def plain(uri: str) -> str:
    """A location with one slash after its scheme, however it was written."""
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def cut_torn_line(spark: SparkSession, path: str, block: int = 1 << 16) -> bool:
    """Cut a file behind its last line break; whether anything was cut.

    Only the end of the file is looked at, from the back; a file that ends as it should is not touched.
    """
    store, at = _open(spark, path)
    size = store.getFileStatus(at).getLen()
    if not size:
        return False
    source, keep, end = store.open(at), 0, size
    try:
        while end and not keep:
            begin = max(0, end - block)
            source.seek(begin)
            found = bytes(source.readNBytes(end - begin)).rfind(b"\n")
            keep, end = begin + found + 1 if found >= 0 else 0, begin
        if keep == size:
            return False
        draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.healed")
        target = store.create(draft, True)
        source.seek(0)
        left = keep
        while left:
            part = source.readNBytes(min(left, 1 << 20))
            target.write(part)
            left -= len(part)
        target.close()
    finally:
        source.close()
    store.delete(at, False)
    return store.rename(draft, at)
