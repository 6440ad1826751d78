"""Ground truth kept bucketed, so evaluations join it without a shuffle.

A truth is written once and scored against many times. It is kept as two bucketed
tables: the pairs by (user_id, item_id), which the join with exploded lists asks for and which
spreads a user with very many items over all buckets, and the users by user_id, for the
semi join that drops lists without a truth. Folders are published as versions
(``recoflow.sinks.publish``), so a reader of an older truth keeps its files.

Defined results: repeated pairs are kept once; nulls are kept and match no list, as in a truth
that is not stored; further columns are dropped; an empty truth scores no user.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from recoflow.sinks.publish import current, publish
from recoflow.sources.files import absolute, join, read_text, replace_text

ABOUT = "_TRUTH"
PAIRS, USERS = ["user_id", "item_id"], ["user_id"]


@dataclass(frozen=True)
class Truth:
    """pairs (user_id, item_id), distinct; users (user_id), distinct; by_user: the pairs in the users'
    buckets, which a store written before there were any lacks."""

    pairs: DataFrame
    users: DataFrame
    by_user: DataFrame | None = None


class TruthStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, absolute(spark, path)

    def exists(self) -> bool:
        return current(self.spark, self.path) != self.path

    def save(self, truth: DataFrame, buckets: int | None = None) -> Truth:
        """Write (user_id, item_id) as the current version. As many buckets as the session has shuffle
        partitions by default: Spark shuffles a table with fewer again."""
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = truth.select(*PAIRS).distinct()
        about = {"buckets": n, "types": dict(pairs.dtypes), "by_user": True}

        def write(folder: str) -> None:
            self._write(pairs, join(folder, "pairs"), PAIRS, n)
            written = self._table(folder, "pairs", PAIRS, about)
            self._write(written.select(*USERS).distinct(), join(folder, "users"), USERS, n)
            self._write(written, join(folder, "by_user"), USERS, n)
            replace_text(self.spark, join(folder, ABOUT), json.dumps(about))

        publish(self.spark, self.path, write)
        return self.load()

    def load(self) -> Truth:
        folder = current(self.spark, self.path)
        about = json.loads(read_text(self.spark, join(folder, ABOUT)))
        by_user = self._table(folder, "by_user", PAIRS, about, USERS) if about.get("by_user") else None
        return Truth(self._table(folder, "pairs", PAIRS, about), self._table(folder, "users", USERS, about), by_user)

    def _name(self, folder: str) -> str:
        return "recoflow_truth_" + hashlib.sha256(folder.encode()).hexdigest()[:32]

    def _write(self, df: DataFrame, folder: str, keys: list[str], n: int) -> None:
        # Dealt as the buckets are: one file per bucket.
        df.repartition(n, *keys).write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys).option("path", folder).saveAsTable(self._name(folder))

    def _table(self, folder: str, table: str, columns: list[str], about: dict, buckets: list[str] | None = None) -> DataFrame:
        """The written table, bucketed by all columns or by ``buckets``; a session that has not written it enters it
        into its catalog first."""
        place = join(folder, table)
        name = self._name(place)
        if not self.spark.catalog.tableExists(name):
            cols, by = ", ".join(f"`{c}` {about['types'][c]}" for c in columns), ", ".join(buckets or columns)
            quoted = place.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {about['buckets']} BUCKETS LOCATION '{quoted}'"
            )
        return self.spark.table(name)
