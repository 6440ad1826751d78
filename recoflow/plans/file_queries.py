"""Registered queries that go through files: each writes what the tables give with a
sink, reads it back with its source, and returns what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.config import DEFAULT_K, ITEM_PREFIX
from recoflow.operators import evaluation as ev
from recoflow.operators import explore as ex
from recoflow.operators import history as hist
from recoflow.operators import truth as tr
from recoflow.plans import checks
from recoflow.plans.inputs import Inputs
from recoflow.plans.recommender import HybridRecommender
from recoflow.session import ensure_checkpoint_dir
from recoflow.sinks import writers
from recoflow.sources import tsv
from recoflow.sources.files import join
from recoflow.sources.tables import HISTORY_ORDER

#: Items of the cut list files.
SHORT = 10
#: Model sizes of the saved recommender.
SAVED = {"k_clusters": 20, "rank": 5, "max_iter": 5, "reg_param": 0.1}


def _folder(spark: SparkSession, name: str) -> str:
    return join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a TSV file, read with its schema and cleaned."""
    path = _folder(spark, "item_history")
    writers.write_table(Inputs(spark, sf_dir).history.select(*hist.HISTORY_COLUMNS), path, "tsv")
    return hist.clean_history(tsv.read_item_history(spark, path))


def file_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file in which every row of item numbers divisible by 7 has a frequency that
    is no number, and every row of user ids divisible by 11 an item id that is none."""
    path = _folder(spark, "item_history")
    rows = Inputs(spark, sf_dir).history.select(
        "user_id", F.when(F.col("user_id") % 11 == 0, "Ix").otherwise(F.col("item_id")).alias("item_id"), "latest_timestamp",
        F.when(F.replace("item_id", F.lit(ITEM_PREFIX), F.lit("")).cast("int") % 7 == 0, "many").otherwise(F.col("frequency").cast("string")).alias("frequency"),
    )
    writers.write_table(rows, path, "tsv")
    good, rejects = tsv.observed(tsv.read_item_history(spark, path), "item_history")
    accepted = good.agg(F.count(F.lit(1)), F.coalesce(F.sum("frequency"), F.lit(0))).first()
    counts = rejects.get
    return spark.createDataFrame(
        [(accepted[0], accepted[1], counts["n_rejected"])], "n_accepted long, frequency long, n_rejected long"
    )


def file_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "frequencies")
    writers.write_table(Inputs(spark, sf_dir).train_freqs, path, "tsv")
    return tsv.read_frequencies(spark, path)


def file_target_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User attributes and target users as files; the attributes of the targets."""
    inp, users, targets = Inputs(spark, sf_dir), _folder(spark, "user_master"), _folder(spark, "target_users")
    writers.write_table(inp.users, users, "tsv")
    writers.write_table(inp.active_targets, targets, "tsv")
    return ex.restrict_users(tsv.read_user_master(spark, users), tsv.read_target_users(spark, targets))


def file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's own list in three kinds of list file: plain, cut to the first items, and
    with a header line and prefixed ids; all read by position."""
    lists = Inputs(spark, sf_dir).own_top_lists()
    lists.write.parquet(kept := _folder(spark, "lists"))  # found once, written by every kind
    lists = spark.read.schema(lists.schema).parquet(kept)
    kinds = {"plain": {}, "cut": {"k": SHORT}, "header": {"header": True, "prefix": ITEM_PREFIX}}
    out = None
    for kind, options in kinds.items():
        path = _folder(spark, f"lists-{kind}")
        writers.write_lists(lists, path, **options)
        back = ev.string_lists_to_arrays(tsv.read_lists(spark, path)).select(
            F.lit(kind).alias("kind"), "user_id", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("recommended_items")
        )
        out = back if out is None else out.unionByName(back)
    return out


def file_truth_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide truth as a file, read back as the distinct pairs that metrics use (item 0 reads as padding)."""
    inp, path = Inputs(spark, sf_dir), _folder(spark, "truth")
    writers.write_truth(tr.truth_wide(inp.users, inp.test_rows, HISTORY_ORDER, DEFAULT_K), path)
    return tsv.read_truth_items(spark, path)


def saved_recommender_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recommender saved and loaded: users, lists that differ, and rows of the cluster history that differ from a recount."""
    inp, path = Inputs(spark, sf_dir), _folder(spark, "recommender")
    rec = HybridRecommender(**SAVED, top_k=DEFAULT_K).fit(inp.train_freqs, inp.users)
    rec.save(path)
    loaded = HybridRecommender.load(spark, path)
    own = rec.recommend_arrays(inp.hybrid_users).withColumnRenamed("items", "_own")
    lists = own.join(loaded.recommend_arrays(inp.hybrid_users), "user_id", "full").agg(
        F.count("user_id").alias("n_users"), checks.violations(~F.col("items").eqNullSafe(F.col("_own"))).alias("n_wrong_list")
    )
    counted = inp.train_freqs.join(loaded.clusters(inp.users), "user_id").groupBy("prediction", "item_id").agg(F.sum("frequency").alias("_counted"))
    rows = counted.join(loaded.cluster_hist, ["prediction", "item_id"], "full")
    wrong = rows.agg(checks.violations(~F.col("frequency").eqNullSafe(F.col("_counted"))).alias("n"))
    return lists.withColumn("n_wrong_history", wrong.scalar())


QUERIES = {
    "file_history": file_history,
    "file_rejects": file_rejects,
    "file_frequencies": file_frequencies,
    "file_target_features": file_target_features,
    "file_lists": file_lists,
    "file_truth_items": file_truth_items,
    "saved_recommender_check": saved_recommender_check,
}
