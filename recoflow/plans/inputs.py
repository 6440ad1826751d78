"""Shared inputs of the registered queries: the fixture views, the temporal
split and the frequency tables derived from them.

Everything here is lazy except the split thresholds, a few scalars computed
when a slice of a data set is first asked for and kept by the state of its files. Each DataFrame is built once
per ``Inputs`` (cached_property), so a query that uses a view several times
shares one analysed subplan and Spark reuses its exchanges.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.config import DEFAULT_K
from recoflow.operators import history as hist
from recoflow.operators import popularity as pop
from recoflow.operators.split import Cut, TemporalSplit, temporal_split
from recoflow.operators.split_index import SplitStore, split_json
from recoflow.operators.truth_store import Truth, TruthStore
from recoflow.session import ensure_checkpoint_dir
from recoflow.sources import tables
from recoflow.sources.files import file_states, join


class Inputs:
    segment_col = "feature1"

    def __init__(self, spark: SparkSession, sf_dir: str, k: int = DEFAULT_K, split: TemporalSplit | None = None):
        if split is not None:
            self.split = split
        self.spark = spark
        self.sf_dir = sf_dir
        self.k = k

    # -- views -----------------------------------------------------------
    @cached_property
    def history(self) -> DataFrame:
        return tables.item_history(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return tables.user_master(self.spark, self.sf_dir)

    @cached_property
    def targets(self) -> DataFrame:
        return tables.target_users(self.spark, self.sf_dir)

    @cached_property
    def active_targets(self) -> DataFrame:
        """Users with a row in the validation slice: a target list given by the data."""
        return self.validation_rows.select("user_id").distinct()

    # -- split -----------------------------------------------------------
    @cached_property
    def split(self) -> TemporalSplit:
        """Found once per state of the two tables' files, and kept in the shared folder."""
        store = SplitStore(self.spark, join(ensure_checkpoint_dir(self.spark), "splits"))
        return store.get(tables.history_tables(self.spark, self.sf_dir), tables.HISTORY_ORDER, self._find_split)

    def _find_split(self) -> TemporalSplit:
        counts = tables.history_time_counts(self.spark, self.sf_dir)
        return temporal_split(self.history, tables.HISTORY_ORDER, leading_counts=counts, rows_at=self._rows_at)

    def _rows_at(self, condition: Column, n: int) -> DataFrame:
        """The history rows of the leading values that hold a cut. Few orders go to
        the line items, which are then not shuffled for a handful of rows."""
        orders = tables.order_times(self.spark, self.sf_dir).where(condition).count()
        few = orders * tables.ORDER_BYTES <= pop.broadcast_threshold(self.spark)
        return tables.item_history(self.spark, self.sf_dir, condition, broadcast=few)

    def _bounded(self, low: Cut | None, high: Cut | None) -> DataFrame:
        """The history with the cuts' time bounds pushed into the scan."""
        out = self.history
        if low is not None and low.kind == "prefix":
            out = out.where(tables.time_bound(low.values[0], False))
        if high is not None and high.kind == "prefix":
            out = out.where(tables.time_bound(high.values[0], True))
        return out

    @cached_property
    def train_rows(self) -> DataFrame:
        return self.split.train(self._bounded(None, self.split.train_cut))

    @cached_property
    def train_test_rows(self) -> DataFrame:
        return self.split.train_test(self._bounded(None, self.split.test_cut))

    @cached_property
    def test_rows(self) -> DataFrame:
        return self.split.test(self._bounded(self.split.train_cut, self.split.test_cut))

    @cached_property
    def validation_rows(self) -> DataFrame:
        return self.split.validation(self._bounded(self.split.test_cut, None))

    # -- derived ---------------------------------------------------------
    @cached_property
    def train_freqs(self) -> DataFrame:
        return hist.item_frequencies(self.train_rows)

    def kept_freqs(self) -> DataFrame:
        """The train frequencies written once to the shared folder, for queries that read them several times."""
        path = join(ensure_checkpoint_dir(self.spark), f"train-freqs-{uuid.uuid4().hex}")
        self.train_freqs.write.parquet(path)
        return self.spark.read.schema(self.train_freqs.schema).parquet(path)

    @cached_property
    def kept_train(self) -> DataFrame:
        """``kept_freqs``, once for the fit and for all that its results are compared with."""
        return self.kept_freqs()

    def kept_slice_freqs(self) -> tuple[DataFrame, DataFrame]:
        """The train and the test frequencies by one pass over the history, written once to the shared folder."""
        path = join(ensure_checkpoint_dir(self.spark), f"slice-freqs-{uuid.uuid4().hex}")
        rows = self.split.labelled(self._bounded(None, self.split.test_cut)).where("slice != 'validation'")
        freqs = hist.item_frequencies(rows, by=["slice"])
        freqs.write.partitionBy("slice").parquet(path)
        kept = self.spark.read.schema(freqs.schema).parquet(path)
        train, test = (kept.where(F.col("slice") == name).drop("slice") for name in ("train", "test"))
        return train, test

    @cached_property
    def test_truth(self) -> DataFrame:
        return hist.item_frequencies(self.test_rows).select("user_id", "item_id")

    def stored_truth(self) -> Truth:
        """The test truth as bucketed tables in the shared folder, written once per state of the files and split."""
        tables_ = tables.history_tables(self.spark, self.sf_dir)
        state = hashlib.sha256(repr([*(sorted(file_states(t)) for t in tables_), split_json(self.split)]).encode()).hexdigest()
        store = TruthStore(self.spark, join(ensure_checkpoint_dir(self.spark), f"truths/{state}"))
        return store.load() if store.exists() else store.save(self.test_truth)

    @cached_property
    def cold_users(self) -> DataFrame:
        """Users of U without a single train row."""
        # Users are read off the per-pair frequencies (one row per pair, already
        # shuffled for the popularity lists, so the exchange is reused), not off
        # the raw slice; distinct() is pre-aggregated on the map side.
        known = self.train_freqs.select("user_id").distinct()
        return self.users.select("user_id").join(known, "user_id", "left_anti")

    @cached_property
    def hybrid_users(self) -> DataFrame:
        """T plus every cold user, so the cold-start branch is exercised."""
        return self.targets.unionByName(self.cold_users).distinct()

    @cached_property
    def user_segments(self) -> DataFrame:
        return self.users.select("user_id", F.col(self.segment_col).alias("segment"))

    def segment_top(self) -> DataFrame:
        popularity = pop.group_popularity(self.train_freqs, self.user_segments, "segment")
        return pop.group_top_k(popularity, "segment", self.k)

    def segment_user_lists(self, users: DataFrame) -> DataFrame:
        lists = pop.group_lists(self.segment_top(), "segment")
        return pop.lists_for_users(users, self.user_segments, lists, "segment")

    def own_top_lists(self) -> DataFrame:
        """Each user's own top-k items in train (stand-in for the ALS list in
        the SQL-checkable merges): (user_id, items)."""
        top = pop.group_top_k(self.train_freqs, "user_id", self.k)
        return pop.group_lists(top, "user_id")

    def global_list(self) -> Column:
        return pop.global_top_array(self.train_freqs, self.k)
