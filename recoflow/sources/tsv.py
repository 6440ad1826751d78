"""Tab-separated readers with one fixed schema per table.

Fields that do not parse under the schema become null (Spark's permissive
CSV mode); ``count_rejects`` reports how many rows lost a required field,
so bad input is counted at load time instead of silently shrinking later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recoflow.functions.lists import item_id
from recoflow.sources.tables import FEATURE_COLS

ITEM_HISTORY_SCHEMA = "user_id int, item_id string, latest_timestamp bigint, frequency int"
USER_MASTER_SCHEMA = "user_id int, " + ", ".join(f"{c} string" for c in FEATURE_COLS)
TARGET_USERS_SCHEMA = "user_id int"
FREQUENCIES_SCHEMA = "user_id int, item_id int, frequency double"
LIST_SCHEMA = "user_id int, recommended_items string"
TRUTH_SCHEMA = "user_id int, items_actioned_on string"


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "PERMISSIVE").csv(path)


#: Columns that a row of each table cannot do without.
REQUIRED = {
    "item_history": ("user_id", "item_id", "latest_timestamp", "frequency"),
    "user_master": ("user_id",),
    "target_users": ("user_id",),
    "frequencies": ("user_id", "item_id", "frequency"),
    "lists": ("user_id", "recommended_items"),
    "truth": ("user_id", "items_actioned_on"),
}


def read_item_history(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ITEM_HISTORY_SCHEMA)


def read_user_master(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, USER_MASTER_SCHEMA)


def read_target_users(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TARGET_USERS_SCHEMA)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, FREQUENCIES_SCHEMA)


def read_lists(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """A list file ``user_id \t id,id,...`` read by position. A header line is
    told from a bad row by its text, and dropped; rows whose user id does not
    parse stay, with a null id, for ``accepted`` to count."""
    raw = read_tsv(spark, path, "user string, recommended_items string", header)
    named = F.coalesce(F.lower(F.trim("user")) == "user_id", F.lit(False))
    return raw.where(~named).select(F.col("user").try_cast("int").alias("user_id"), "recommended_items")


def accepted(df: DataFrame, table: str) -> tuple[DataFrame, int]:
    """(rows with all required fields, number of the others); an item id that
    is no "I<number>" counts as missing."""
    bad = _lacking(df, table)
    return df.where(~bad), df.where(bad).count()


def observed(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """``accepted`` in one pass: the others are counted while the first action on the
    result reads the file; ``get["n_rejected"]`` of the observation holds their number then."""
    bad, rejects = _lacking(df, table), Observation()
    return df.observe(rejects, F.count_if(bad).alias("n_rejected")).where(~bad), rejects


def _lacking(df: DataFrame, table: str) -> Column:
    required = list(REQUIRED[table])
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    if "item_id" in required and dict(df.dtypes)["item_id"] == "string":
        bad = bad | item_id(F.col("item_id")).isNull()
    return bad


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH_SCHEMA)


def count_rejects(df: DataFrame, required: Sequence[str]) -> int:
    """Rows where any of ``required`` is null after parsing (one scalar)."""
    cond = F.lit(False)
    for c in required:
        cond = cond | F.col(c).isNull()
    return df.where(cond).count()


def read_truth_items(spark: SparkSession, path: str, pad: str = "0") -> DataFrame:
    """A wide truth file (``user_id \\t id,id,...,0,0``) as the long, distinct
    (user_id, item_id) table the metrics use. Pad tokens are dropped; the wide
    format cannot tell a real item ``0`` from padding, so item 0 is lost here
    (the long truth built from the history keeps it)."""
    wide = read_truth(spark, path).where(F.col("user_id").isNotNull())
    items = wide.select("user_id", F.explode(F.split("items_actioned_on", ",")).alias("_t"))
    return (
        items.where((F.col("_t") != F.lit(pad)) & (F.col("_t") != F.lit("")))
        .select("user_id", item_id(F.col("_t")).alias("item_id"))
        .where(F.col("item_id").isNotNull())
        .distinct()
    )
