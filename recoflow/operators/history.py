"""History cleaning, temporal slices and per-(user, item) frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.functions.lists import strip_item_prefix
from recoflow.operators.split import TemporalSplit

HISTORY_COLUMNS = ("user_id", "item_id", "latest_timestamp", "frequency")


def clean_history(history: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw history -> (user_id int, item_id int, latest_timestamp, frequency int):
    strips the "I" prefix from item ids and casts; extra ``keep`` columns pass through."""
    return history.select(
        F.col("user_id").cast("int").alias("user_id"),
        strip_item_prefix("item_id").alias("item_id"),
        F.col("latest_timestamp"),
        F.col("frequency").cast("int").alias("frequency"),
        *keep,
    )


def label_slices(history: DataFrame, split: TemporalSplit, name: str = "slice") -> DataFrame:
    return split.labelled(history, name)


def item_frequencies(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum ``frequency`` per (user, item): (user_id int, item_id int, frequency double).
    ``by`` names further columns to group by, such as the slice; they come last.

    ``rows`` may be raw (string item ids) or cleaned; a partial aggregate
    runs before the shuffle, so repeated pairs collapse map-side.
    """
    item = strip_item_prefix("item_id") if dict(rows.dtypes)["item_id"] == "string" else F.col("item_id")
    return (
        rows.select(F.col("user_id").cast("int").alias("user_id"), item.alias("item_id"), "frequency", *by)
        .groupBy("user_id", "item_id", *by)
        .agg(F.sum(F.col("frequency").cast("double")).alias("frequency"))
        .select("user_id", "item_id", "frequency", *by)
    )


def slice_summary(labelled: DataFrame, name: str = "slice") -> DataFrame:
    """Rows, users, items and time range per slice."""
    return labelled.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.min("latest_timestamp").alias("min_timestamp"),
        F.max("latest_timestamp").alias("max_timestamp"),
    )
