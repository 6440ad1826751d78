"""Parquet sources and the fixture views H (item_history), U (user_master)
and T (target_users) over the driver's TPC-H-style test tables.

Each view selects only the columns it needs, so the parquet scans carry a
pruned ``ReadSchema``; filters placed on top are pushed into the scans by
Catalyst wherever the column is a plain parquet column.
"""

from __future__ import annotations

import datetime
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.config import ITEM_PREFIX

# Total order of the history: timestamp first, then enough keys to make it unique.
HISTORY_ORDER = (
    "latest_timestamp",
    "user_id",
    "l_partkey",
    "o_orderkey",
    "l_linenumber",
    "l_suppkey",
    "l_quantity",
)

FEATURE_COLS = tuple(f"feature{i}" for i in range(1, 7))


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def to_int_id(col: Column | str) -> Column:
    """64-bit key -> 32-bit id (MLlib ids are ints). Under ANSI mode the cast
    raises on overflow, which is the range check."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("int")


#: Bytes, at most, of an order in a join's build side (key, customer, date and the row's overhead).
ORDER_BYTES = 64


def item_history(spark: SparkSession, sf_dir: str, orders_at: Column | None = None, broadcast: bool = False) -> DataFrame:
    """H: one row per line item, with the tie-break keys of ``HISTORY_ORDER``.

    Columns: user_id int, item_id string ("I" + partkey), latest_timestamp
    bigint (epoch seconds of the order date), frequency int, plus the keys.
    With ``orders_at``, a condition on ``latest_timestamp``, only the rows of these orders;
    ``broadcast`` if the caller knows that they are few, so that no line item is shuffled.
    """
    lineitem = read_table(
        spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    )
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    if orders_at is not None:
        dated = orders.withColumn("latest_timestamp", F.unix_timestamp("o_orderdate")).where(orders_at)
        orders = dated.select("o_orderkey", "o_custkey", "o_orderdate")
    if broadcast:
        orders = F.broadcast(orders)
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey, "inner")
    return joined.select(
        to_int_id("o_custkey").alias("user_id"),
        F.concat(F.lit(ITEM_PREFIX), F.col("l_partkey").cast("string")).alias("item_id"),
        F.unix_timestamp("o_orderdate").alias("latest_timestamp"),
        F.col("l_quantity").cast("int").alias("frequency"),
        "l_partkey",
        "o_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
        "o_orderdate",
    )


def history_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The tables that H is made of."""
    return [read_table(spark, sf_dir, name) for name in ("lineitem", "orders")]


def order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``latest_timestamp`` of every order."""
    return read_table(spark, sf_dir, "orders", ["o_orderdate"]).select(F.unix_timestamp("o_orderdate").alias("latest_timestamp"))


def history_time_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of H per ``latest_timestamp`` (columns latest_timestamp, _n), with
    line items counted per order *before* the join: the join then moves one
    row per order instead of one per line item (same counts as grouping H)."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("_lines")
    )
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "inner")
    return joined.groupBy(F.unix_timestamp("o_orderdate").alias("latest_timestamp")).agg(
        F.sum("_lines").alias("_n")
    )


def time_bound(epoch_seconds: int | None, upper: bool) -> Column:
    """``latest_timestamp <= t`` (or ``>= t``) restated on the stored order date,
    so that the bound reaches the orders scan as a pushed filter; the derived
    epoch column alone cannot be pushed. An epoch second covers all instants
    before the next one; a null date sorts first."""
    if epoch_seconds is None:
        return F.lit(True)
    second = datetime.datetime.fromtimestamp(int(epoch_seconds) + int(upper), tz=datetime.timezone.utc)
    lit = F.lit(second.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    date = F.col("o_orderdate")
    return date.isNull() | (date < lit) if upper else date >= lit


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream's rows (``ts`` has microseconds)."""
    return read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])


def user_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: user_id int and six categorical string features."""
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
    return joined.select(
        to_int_id("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("feature1"),
        F.col("n_name").alias("feature2"),
        F.col("n_regionkey").cast("string").alias("feature3"),
        F.floor(F.col("c_acctbal") / 2000).cast("string").alias("feature4"),
        (F.col("c_custkey") % 7).cast("string").alias("feature5"),
        F.when(F.col("c_acctbal") < 0, F.lit("neg")).otherwise(F.lit("pos")).alias("feature6"),
    )


def target_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: the users to recommend to. The test tables carry no target list, so
    every user of U is a target (the whole table, no id subset)."""
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey"])
    users = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left_semi")
    return users.select(to_int_id("c_custkey").alias("user_id"))
