"""Writers for lists, truth tables, submissions and intermediate tables.

Lists travel as arrays inside the engine; the comma-joined string is built
only here, at the edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.config import ITEM_PREFIX
from recoflow.functions.lists import join_items


def _tsv(df: DataFrame, path: str, header: bool, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def list_strings(lists: DataFrame, items_col: str = "items", name: str = "recommended_items", prefix: str = "") -> DataFrame:
    """(user_id, array) -> (user_id, "id,id,..."); ``prefix`` = "I" restores item ids."""
    if dict(lists.dtypes)[items_col].startswith("array<struct"):
        items = F.transform(F.col(items_col), lambda s: s["item_id"])
    else:
        items = F.col(items_col)
    return lists.select("user_id", join_items(items, prefix).alias(name))


def write_lists(lists: DataFrame, path: str, header: bool = False, prefix: str = "", k: int | None = None) -> None:
    """``user_id \\t id,id,...``; with ``k`` only the first k items are written.
    Accepts plain arrays or ALS ``array<struct<item_id, rating>>``."""
    if k is not None:
        lists = lists.withColumn("items", F.slice("items", 1, k))
    _tsv(list_strings(lists, prefix=prefix), path, header)


def write_submission(lists: DataFrame, path: str, single_file: bool = False) -> None:
    """Submission table: header, ids prefixed with "I", column ``recommend_items``.

    By default written in parallel (one part file per partition, each with
    its header). ``single_file=True`` gives the one-file deliverable: a
    ``repartition(1)`` (a shuffle, unlike ``coalesce(1)``) keeps the lists
    built in parallel and makes only the final write a single task."""
    out = list_strings(lists, name="recommend_items", prefix=ITEM_PREFIX)
    _tsv(out.repartition(1) if single_file else out, path, header=True)


def write_truth(truth_wide: DataFrame, path: str) -> None:
    _tsv(truth_wide.select("user_id", "items_actioned_on"), path, header=True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    """Intermediate tables (frequencies, cluster history): Parquet by default, TSV optional."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "tsv":
        _tsv(df, path, header)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def save_model(model, path: str) -> None:
    """Any MLlib model / PipelineModel, overwriting."""
    model.write().overwrite().save(path)


def model_dir(base: str, kind: str, **params) -> str:
    """Directory of a saved model named from its hyper-parameters, dots
    dropped from numbers: ``als_20_01_200`` for maxIter=20, regParam=0.1, rank=200."""
    parts = [str(v).replace(".", "") for v in params.values()]
    return "/".join([base.rstrip("/"), "_".join([kind, *parts])])
