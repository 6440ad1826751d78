"""Exploration: value counts of the categorical features, distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.sources.tables import FEATURE_COLS


def feature_value_counts(users: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """(feature, value, count) for all feature columns in one pass: the
    columns are unpivoted to (feature, value) and counted together."""
    long = users.unpivot(ids=[], values=list(cols), variableColumnName="feature", valueColumnName="value")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))


def sorted_value_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy("feature", F.desc("count"), "value")


def ranked_value_counts(counts: DataFrame) -> DataFrame:
    """Value counts with their rank inside the feature (count descending, value ascending)."""
    w = Window.partitionBy("feature").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w))


def distinct_summary(history: DataFrame, users: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: history rows, distinct users / items in the history, users in
    the master table, distinct target users. Each distinct count is an
    aggregate over its own table; the one-row results meet as scalar subqueries."""

    def distinct(df: DataFrame, col: str):
        return df.select(col).where(F.col(col).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()

    return history.agg(F.count(F.lit(1)).alias("n_history_rows")).select(
        "n_history_rows",
        distinct(history, "user_id").alias("n_history_users"),
        distinct(history, "item_id").alias("n_history_items"),
        distinct(users, "user_id").alias("n_master_users"),
        distinct(targets, "user_id").alias("n_target_users"),
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows (-1 = all), as a frame; the driver sees n rows at most."""
    return df if n == -1 else df.limit(n)


def first_users(users: DataFrame, n: int) -> DataFrame:
    """The n smallest user ids (a deterministic "first n targets"); planned as
    a per-partition top-n plus a final merge of n rows each."""
    return users.select("user_id").orderBy("user_id").limit(n)


def restrict_users(users: DataFrame, sample: DataFrame) -> DataFrame:
    """Users that also appear in ``sample`` (semi join, no columns added)."""
    return users.join(sample.select("user_id"), "user_id", "left_semi")
