"""Popularity lists: global top-K and top-K inside user groups (segments or clusters).

Ties are always broken by ``item_id`` ascending, so every list is defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.config import DEFAULT_K
from recoflow.functions.lists import join_items


def item_popularity(freqs: DataFrame) -> DataFrame:
    """(item_id, frequency) summed over all users."""
    return freqs.groupBy("item_id").agg(F.sum("frequency").alias("frequency"))


def global_top_k(freqs: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Top-k items by total frequency: (item_id, frequency, rank 1..k).

    ``orderBy + limit`` is planned as a per-partition top-k merged into k rows
    (TakeOrderedAndProject); the k survivors are ranked by sorting them as one
    k-long array, so no window ever sees more than those k rows."""
    top = item_popularity(freqs).orderBy(F.desc("frequency"), F.asc("item_id")).limit(k)
    # struct(-frequency, item_id) ascending = frequency desc, then item_id asc.
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("nf"), "item_id"))).alias("_a"))
    return ranked.select(F.posexplode("_a").alias("_p", "_s")).select(
        F.col("_s.item_id").alias("item_id"),
        (-F.col("_s.nf")).alias("frequency"),
        (F.col("_p") + 1).cast("int").alias("rank"),
    )


def global_top_array(freqs: DataFrame, k: int = DEFAULT_K) -> Column:
    """The global top-k as a lazy scalar subquery (an array of k ids, the empty
    array without any item): nothing runs while a plan is built, and the
    subquery's aggregation is reused where a plan asks for it again."""
    top = item_popularity(freqs).orderBy(F.desc("frequency"), F.asc("item_id")).limit(k)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("nf"), "item_id")))
    return top.agg(F.transform(ranked, lambda s: s["item_id"]).cast("array<int>").alias("items")).scalar()


def global_top_list(freqs: DataFrame, k: int = DEFAULT_K) -> list[int]:
    """The global top-k as a driver-side list (k ids, a proven bound)."""
    rows = item_popularity(freqs).orderBy(F.desc("frequency"), F.asc("item_id")).limit(k).collect()  # k rows
    return [r["item_id"] for r in rows]


def group_popularity(freqs: DataFrame, user_groups: DataFrame, group_col: str) -> DataFrame:
    """(group, item_id, frequency): frequencies of the users of each group.

    ``user_groups`` is one row per user; only (user_id, group) is read, so
    the join carries two columns, and the aggregate runs partially before
    its shuffle (a hot group is pre-folded per map task)."""
    groups = user_groups.select("user_id", group_col)
    return (
        freqs.join(groups, "user_id", "inner")
        .groupBy(group_col, "item_id")
        .agg(F.sum("frequency").alias("frequency"))
    )


def group_top_k(popularity: DataFrame, group_col: str, k: int = DEFAULT_K) -> DataFrame:
    """(group, item_id, frequency, rank) with rank <= k per group.

    Planned as a partial WindowGroupLimit before the shuffle and a final one
    after it, so a group never ships more than k rows per map partition."""
    w = Window.partitionBy(group_col).orderBy(F.desc("frequency"), F.asc("item_id"))
    return popularity.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def group_lists(top: DataFrame, group_col: str) -> DataFrame:
    """One ranked array per group: (group, items array<int>). Groups hold <= k
    rows after ``group_top_k``, so the collected arrays are bounded by k."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return top.groupBy(group_col).agg(F.transform(ranked, lambda s: s["item_id"]).alias("items"))


def broadcast_threshold(spark) -> int:
    """The session's broadcast limit in bytes (-1 disables broadcasting)."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = str(raw).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if raw.endswith(suffix) and raw[: -len(suffix)].strip().lstrip("-").isdigit():
            return int(raw[: -len(suffix)]) * units[suffix]
    return int(raw)


def list_table_bytes(max_groups: int, k: int) -> int:
    """Upper bound of a (group, items<=k ints) table: row overhead + ids."""
    return max_groups * (64 + 8 * k)


def lists_for_users(
    users: DataFrame,
    user_groups: DataFrame,
    lists: DataFrame,
    group_col: str,
    max_groups: int | None = None,
    k: int = DEFAULT_K,
    salt: int = 16,
) -> DataFrame:
    """Give each user the list of their group: (user_id, items).

    The per-group table has one row per group. When the caller knows a
    bound on the number of groups (e.g. KMeans k) and ``max_groups * k``
    ids fit under the session's broadcast threshold, it is broadcast.
    Otherwise the join is salted: each group's (K-bounded) row is
    replicated ``salt`` times and every user draws a salt from a hash of
    its id, so a group holding a third of all users is spread over
    ``salt`` join partitions instead of one (AQE may still turn the join
    into a broadcast once it has measured the list table)."""
    members = users.select("user_id").join(user_groups.select("user_id", group_col), "user_id", "inner")
    limit = broadcast_threshold(lists.sparkSession)
    if max_groups is not None and 0 <= list_table_bytes(max_groups, k) <= limit:
        return members.join(F.broadcast(lists), group_col, "inner").select("user_id", "items")
    if salt <= 1:
        return members.join(lists, group_col, "inner").select("user_id", "items")
    salted_lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    salted_members = members.withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.lit(salt)).cast("int"))
    return salted_members.join(salted_lists, [group_col, "_salt"], "inner").select("user_id", "items")


def as_list_strings(user_lists: DataFrame, items_col: str = "items", name: str = "recommended_items") -> DataFrame:
    return user_lists.select("user_id", join_items(items_col).alias(name))
