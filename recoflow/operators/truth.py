"""Ground truth from a history slice.

The metric path only needs *which* items a user touched in the slice, so the
truth is kept long and distinct. The reference's wide file (items repeated
by frequency in history order, padded with "0" to K) is produced only as an
export, for files that other tools read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.config import DEFAULT_K, TRUTH_PAD
from recoflow.functions.lists import pad_to, strip_item_prefix
from recoflow.operators.history import item_frequencies
from recoflow.session import ensure_checkpoint_dir
from recoflow.sources.files import join

#: Items in one row of a chunked list.
TRUTH_CHUNK = 4096


def truth_long(slice_rows: DataFrame) -> DataFrame:
    """(user_id, item_id, frequency) summed per pair over the slice."""
    return item_frequencies(slice_rows)


def truth_items(slice_rows: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id) of the slice: membership is all nDCG needs."""
    return truth_long(slice_rows).select("user_id", "item_id")


def truth_wide(
    users: DataFrame,
    slice_rows: DataFrame,
    order_cols: Sequence[str],
    k: int = DEFAULT_K,
    pad: str = TRUTH_PAD,
) -> DataFrame:
    """Export form: (user_id, items_actioned_on) for every user of ``users``.

    Each history row contributes its item ``frequency`` times, in history
    order; the list is padded with "0" up to k and never cut. A user with no
    rows in the slice gets k pads. The row of one user is by definition the
    user's whole slice, so this is a sink format, not an input of the metrics.
    """
    item = strip_item_prefix("item_id") if dict(slice_rows.dtypes)["item_id"] == "string" else F.col("item_id")
    keyed = slice_rows.select(
        F.col("user_id").cast("int").alias("user_id"),
        F.struct(*[F.col(c) for c in order_cols], item.cast("string").alias("_item"), F.col("frequency").alias("_f")).alias("_r"),
    )
    per_user = keyed.groupBy("user_id").agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    repeated = F.flatten(F.transform(F.col("_rows"), lambda r: F.array_repeat(r["_item"], r["_f"].cast("int"))))
    everyone = users.select(F.col("user_id").cast("int").alias("user_id")).join(per_user, "user_id", "left")
    items = F.coalesce(repeated, F.array().cast("array<string>"))
    return everyone.select("user_id", F.array_join(pad_to(items, k, pad), ",").alias("items_actioned_on"))


def truth_chunks(
    users: DataFrame,
    slice_rows: DataFrame,
    order_cols: Sequence[str],
    k: int = DEFAULT_K,
    pad: str = TRUTH_PAD,
    chunk: int = TRUTH_CHUNK,
) -> DataFrame:
    """(user_id, chunk, items_actioned_on): the lists of ``truth_wide`` in numbered pieces
    of at most ``chunk`` items, so no row and no task holds a user's whole slice.

    Positions come from prefix sums in two passes: the rows are range-partitioned by user
    and history order (a long history spans partitions) and written; sums per (user,
    partition) give each partition's first position, a running sum inside it the rest.
    Rows with no positive frequency add nothing; users without rows get pads only.
    """
    spark = users.sparkSession
    item = strip_item_prefix("item_id") if dict(slice_rows.dtypes)["item_id"] == "string" else F.col("item_id")
    order = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)]
    names = [f"_o{i}" for i in range(len(order))]
    everyone = users.select(F.col("user_id").cast("int").alias("user_id")).distinct()
    rows = slice_rows.select(
        F.col("user_id").cast("int").alias("user_id"), *order, item.cast("string").alias("_item"), F.col("frequency").cast("long").alias("_f")
    ).where("_f > 0").join(everyone, "user_id", "left_semi")
    path = join(ensure_checkpoint_dir(spark), f"truth-{uuid.uuid4().hex}")
    dealt = rows.repartitionByRange("user_id", *names, "_item").withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)

    totals = placed.groupBy("user_id", "_part").agg(F.sum("_f").alias("_n"))
    earlier = Window.partitionBy("user_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("user_id", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("user_id", "_part").orderBy(*names, "_item").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("_f").over(inside)).join(bases, ["user_id", "_part"])
    pieces = placed.select("user_id", "_item", (F.col("_base") + F.col("_end") - F.col("_f")).alias("_start"), "_f")
    counts = totals.groupBy("user_id").agg(F.sum("_n").alias("_n"))
    have = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    pads = everyone.join(counts, "user_id", "left").where(have < k)
    pads = pads.select("user_id", F.lit(pad).alias("_item"), have.alias("_start"), (F.lit(k) - have).alias("_f"))

    stop = F.col("_start") + F.col("_f")
    first, last = F.floor(F.col("_start") / chunk), F.floor((stop - 1) / chunk)
    cut = pieces.unionByName(pads).withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_start"), F.col("chunk") * chunk)
    cut = cut.select(
        "user_id", "chunk", F.struct(begin.alias("_at"), "_item", (F.least(stop, (F.col("chunk") + 1) * chunk) - begin).cast("int").alias("_times")).alias("_r")
    )
    lists = cut.groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    items = F.flatten(F.transform("_rows", lambda r: F.array_repeat(r["_item"], r["_times"])))
    return lists.select("user_id", "chunk", F.array_join(items, ",").alias("items_actioned_on"))
