"""Small files through Spark's own file systems, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: another text once the table has changed."""
    fs, at = _at(spark, path)
    found = fs.listStatus(at) if fs.exists(at) else []
    return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in found))


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A new file; one that is there already is an error (FileExistsError)."""
    fs, at = _at(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
