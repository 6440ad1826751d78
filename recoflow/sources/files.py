"""Paths of any file system that Spark reaches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def join(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def absolute(spark: SparkSession, path: str) -> str:
    """With scheme and working folder, as a table's location must be given."""
    p, fs = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def file_states(df: DataFrame) -> list[tuple[str, str]]:
    """(path as in ``_metadata.file_path``, length and time of change) of the files that ``df`` reads; one listing per folder."""
    spark, files = df.sparkSession, df.inputFiles()
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    states = {}
    for folder in sorted({os.path.dirname(f) for f in files}):  # as URIs
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for status in p.getFileSystem(conf).listStatus(p):
            states[folder, status.getPath().toUri().getRawPath().rsplit("/", 1)[1]] = f"{status.getLen()}:{status.getModificationTime()}"
    return [(f.replace(":///", ":/", 1), states[os.path.dirname(f), os.path.basename(f)]) for f in files]


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over the old one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p, fs = _hadoop(spark, path)
    fresh = hadoop.Path(path + ".fresh")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(fresh), fs.makeQualified(p), options)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
