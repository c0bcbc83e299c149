"""Small file operations on whatever store Spark writes to (Hadoop's
FileSystem, on the driver): existence, listing and renaming of marker files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is missing."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that nothing has taken yet, by a
    rename, so that it is there whole or not at all. False if it was taken."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(draft, p)) if not fs.exists(p) else False


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
