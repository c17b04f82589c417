"""Small files on any file system that Spark reaches: manifests, requests and listings, by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    p, files = _at(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(p)) if files.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _at(spark, path)
    return files.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, files = _at(spark, path)
    stream = files.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet: whole under another name first, then renamed. False if another writer was quicker."""
    p, files = _at(spark, path)
    if files.exists(p):
        return False
    files.mkdirs(p.getParent())
    draft, _ = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.rename(draft, p):
        return True
    files.delete(draft, False)
    return False


def remove(spark: SparkSession, path: str) -> None:
    p, files = _at(spark, path)
    files.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    p, files = _at(spark, path)
    return files.getContentSummary(p).getLength() if files.exists(p) else 0
