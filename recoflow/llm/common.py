"""Helpers shared by the training-data operators.

Intermediate tables are written as Parquet under the shared folder the
cluster names in ``spark.checkpoint.dir``; a lost executor's successor
rereads them. Folders that no later step reads are removed with ``drop``.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from recoflow.session import ensure_checkpoint_dir

#: The word of all operators that count or compare words (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: A written table makes the shuffle files behind it needless.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return path or ensure_checkpoint_dir(spark)


def ship_code(spark: SparkSession) -> None:
    """Put this package, as a zip in the shared folder, on the Python path of the
    executors (once per application), so that they need no installed copy."""
    name = "recoflow-code.zip"
    sc = spark.sparkContext
    if name in sc._python_includes:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{shared_dir(spark).rstrip('/')}/code-{uuid.uuid4().hex}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)


class Work:
    """One operator call's folder of intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, survives lost executors."""
        with settings(self.spark, CLEANUP):
            df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def keep_small(self, df: DataFrame, name: str) -> DataFrame:
        """``keep`` with the stronger compression, for texts that are read once more."""
        with settings(self.spark, {"spark.sql.parquet.compression.codec": "zstd"}):
            return self.keep(df, name)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the duration of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
