"""Folds and random splits.

A fold is a pure function of the row key (the leading 32 bits of the md5 of
``key:key:seed``, modulo k), which plain SQL can repeat, so it is the same on every executor and after any repartitioning, and
"train on all other folds" is a filter, not a union of k-1 frames.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflow.config import SEED
from recoflow.operators.split import Cut, locate_ranks, rows_between


def fold_of(cols: Sequence[str], k: int, seed: int = SEED) -> Column:
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def assign_folds(df: DataFrame, k: int, cols: Sequence[str] = ("user_id", "item_id"), seed: int = SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, fold_of(cols, k, seed))


def fold_train(df: DataFrame, i: int, name: str = "fold") -> DataFrame:
    return df.where(F.col(name) != i)


def fold_test(df: DataFrame, i: int, name: str = "fold") -> DataFrame:
    return df.where(F.col(name) == i)


def random_split(df: DataFrame, weights: Sequence[float], seed: int = SEED) -> list[DataFrame]:
    """Spark's seeded ``randomSplit``; weights are normalised to sum to 1."""
    return df.randomSplit(list(weights), seed=seed)


def split_label(df: DataFrame, weights: Sequence[float], seed: int = SEED, name: str = "split", cols: Sequence[str] | None = None) -> DataFrame:
    """One labelled frame instead of several: row -> index of its part.

    Rows are ranked by the md5 of their key (``cols``, all columns by default) and the parts are cut at exact
    ranks, so their sizes are the weights' to the row whatever the partitioning, and plain SQL can
    repeat them. The cuts are found as in the temporal split: counts of the hash's first 16 bits, then only the
    rows of the bucket that holds a cut; the parts are range filters on the hash."""
    keys = list(cols or df.columns)
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)))))
    hashed = hashed.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
        ms, acc = [], 0.0
        for w in weights[:-1]:
            acc += w
            ms.append(int(n * acc / sum(weights) + 1e-9))
        cuts = locate_ranks(hashed, ("_bucket", "_hash"), ms, n, counts)
    finally:
        counts.unpersist()
    bounds = [Cut("none"), *cuts, Cut("all")]
    if any(c.among_copies for c in cuts):  # equal rows on both sides of a cut
        parts = [rows_between(hashed, lo, hi).withColumn(name, F.lit(i)) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
        return reduce(DataFrame.unionByName, parts).drop("_hash", "_bucket")
    label = F.lit(len(weights) - 1)
    for i in range(len(cuts) - 1, -1, -1):
        label = F.when(cuts[i].le(), F.lit(i)).otherwise(label)
    return hashed.withColumn(name, label).drop("_hash", "_bucket")
