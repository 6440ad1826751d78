"""A maintained index for the temporal split.

``CountIndex`` keeps, beside the data, the number of rows per value of the leading
key and input file. A file is known by path, length and time of change: an update counts only files that
the index does not know, and counts of files that have gone or changed are left out, so the
split of a growing history is found without rescanning it (only the rows of the one leading value that
holds a cut are read again, by a filter that reaches the scan).

``SplitStore`` keeps found splits by the state of the files they were found on (plus key columns and
fractions). Changed, added or removed files are another state and give a fresh split.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.config import TEST_FRACTION, TRAIN_FRACTION
from recoflow.operators.split import Cut, TemporalSplit, temporal_split
from recoflow.sources.files import file_states, join, path_exists


def split_json(split: TemporalSplit) -> str:
    return json.dumps(asdict(split))


def split_of(text: str) -> TemporalSplit:
    doc = json.loads(text)
    cuts = {
        name: Cut(**{k: tuple(v) if isinstance(v, list) else v for k, v in doc.pop(name).items()}) for name in ("train_cut", "test_cut")
    }
    return TemporalSplit(cols=tuple(doc.pop("cols")), **doc, **cuts)


def save_split(spark: SparkSession, split: TemporalSplit, path: str) -> None:
    """The split as a one-row table, on whatever file system ``path`` names."""
    spark.createDataFrame([(split_json(split),)], "split string").write.mode("overwrite").parquet(path)


def load_split(spark: SparkSession, path: str) -> TemporalSplit:
    return split_of(spark.read.parquet(path).first()["split"])


class CountIndex:
    """Rows per leading key and file under ``path``: (file, state, ``lead``, _n)."""

    def __init__(self, spark: SparkSession, path: str, lead: str):
        self.spark, self.path, self.lead = spark, path, lead

    def _table(self) -> str:
        return join(self.path, f"counts_by_{self.lead}")

    def _known(self) -> DataFrame | None:
        return self.spark.read.parquet(self._table()) if path_exists(self.spark, self._table()) else None

    def update(self, history: DataFrame) -> list[str]:
        """Count the files of ``history`` (read from files) that the index does not know; returns them."""
        present = self._states(history)
        known = self._known()
        fresh = present if known is None else present.join(known.select("file", "state").distinct(), ["file", "state"], "left_anti")
        new = [r["file"] for r in fresh.collect()]  # file names, as many as the scan's own listing has
        if new:
            rows = history.select(F.col(self.lead), F.col("_metadata.file_path").alias("file")).where(F.col("file").isin(new))
            counts = rows.groupBy("file", self.lead).agg(F.count(F.lit(1)).alias("_n"))
            empty = fresh.select("file", "state").join(counts, "file", "left")  # files without rows are known too
            empty.withColumn("_n", F.coalesce("_n", F.lit(0).cast("long"))).write.mode("append").parquet(self._table())
        return new

    def counts(self, history: DataFrame) -> DataFrame:
        """(lead, _n) over the files that ``history`` has now; ``update`` comes first."""
        known = self._known()
        if known is None:
            return history.groupBy(self.lead).agg(F.count(F.lit(1)).alias("_n"))
        rows = known.join(self._states(history), ["file", "state"], "left_semi")
        return rows.where("_n > 0").groupBy(self.lead).agg(F.sum("_n").alias("_n"))

    def split(self, history: DataFrame, order_cols: Sequence[str], train: float = TRAIN_FRACTION, test: float = TEST_FRACTION) -> TemporalSplit:
        self.update(history)
        return temporal_split(history, order_cols, train, test, leading_counts=self.counts(history))

    def _states(self, history: DataFrame) -> DataFrame:
        return self.spark.createDataFrame(file_states(history), "file string, state string")


class SplitStore:
    """Splits under ``path`` by the state of their files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, sources: Iterable[DataFrame], parameters: Sequence, find: Callable[[], TemporalSplit]) -> TemporalSplit:
        """The split stored for the files of ``sources`` as they are now, else ``find()``, then stored."""
        states = [sorted(file_states(s)) for s in sources]
        key = hashlib.sha256(json.dumps([states, list(parameters)], default=str).encode()).hexdigest()
        at = join(self.path, key)
        if path_exists(self.spark, join(at, "_SUCCESS")):
            return load_split(self.spark, at)
        split = find()
        save_split(self.spark, split, at)
        return split
