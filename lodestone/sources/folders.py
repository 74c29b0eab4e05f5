"""Folders of any file system that Spark reads: what a commit and a cleaning need."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; empty if there is none."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """A file, or a folder with all in it; False if there is none."""
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Rename a folder, which is one step on file systems that rename; an error if ``path`` is there."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    plain = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.Path(made), p, plain)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of files, or of what lies in folders, as one text."""
    said = []
    for path in paths:
        fs, p = _at(spark, path)
        said += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(p)]
    return "\n".join(said)
