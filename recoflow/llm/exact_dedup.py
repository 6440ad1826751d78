"""Exact deduplication as a stateful stream (operator 10, DataFrame functions only).

The rows arrive as a stream of (digest, stable id, content locator). One
streaming aggregation without a watermark keeps, per digest and without expiry,
the row that stays and the number of rows; its state lives in RocksDB on the
executors' disks and is checkpointed in the shared folder. The state is then
read back with Spark's state reader. Every hit (a digest with more rows) is
checked on the full bytes against the row that stays; digests whose texts differ
are grouped again by the text itself, so the result does not rest on the digest.

Defined results: a null text counts as empty; null ids sort lowest; a repeated
row (same id, same text) is one more row of its group, and exactly one row per
group is kept (largest id, then largest file path and row position); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from recoflow.llm.common import Work, settings

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Copies that one copy of the kept text is compared with before it is replicated.
COPIES_PER_CHECK = 256


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def from_files(work: Work, docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have a file position, else a written copy."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        docs.write.parquet(work.at("documents"))
        return work.spark.read.parquet(work.at("documents"))


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, file, row): the content locator of each row is its file and position."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
        meta["file_path"].alias("file"), meta["row_index"].alias("row"),
    )


def keyed_state(spark: SparkSession, work: Work, arrivals: DataFrame) -> DataFrame:
    """Stream the arrivals through the keyed state; read (digest, keep, group_size) back."""
    with settings(spark, ROCKSDB):
        stream = spark.readStream.schema(arrivals.schema).parquet(work.at("arrivals"))
        (
            stream.groupBy("digest")
            .agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", work.at("state"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    state = spark.read.format("statestore").load(work.at("state"))
    keep, size = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[keep].alias("keep"),
        F.col("value")[size].alias("group_size"),
    )


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, file, row."""
    work = Work(spark, "exact-dedup")
    rows = located(from_files(work, docs), id_col, text_col)
    arrivals = work.keep(
        rows.select("id", "file", "row", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256")),
        "arrivals",
    )
    if arrivals.isEmpty():
        return _decisions(arrivals.withColumns({"keep": F.struct("id", "file", "row"), "group_size": F.lit(1).cast("long")}))
    hits = work.keep(keyed_state(spark, work, arrivals).where("group_size > 1"), "hits")
    texts = work.keep(
        rows.withColumn("digest", digest(F.col("text"))).join(hits.hint("merge"), "digest"), "texts"
    )
    decided = arrivals.join(hits, "digest", "left").withColumns({
        "keep": F.coalesce("keep", F.struct("id", "file", "row")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
    })
    differing = work.keep(_differing(texts), "differing")
    if differing.isEmpty():
        return _decisions(decided)
    # Digests shared by different texts: group these by the whole text.
    again = texts.select("digest", "id", "text", "file", "row").join(differing, "digest", "left_semi")
    groups = again.groupBy("digest", "text").agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    split = again.join(groups, ["digest", "text"]).withColumn("text_sha256", sha256(F.col("text")))
    columns = ["id", "file", "row", "text_sha256", "keep", "group_size"]
    return _decisions(
        decided.join(differing, "digest", "left_anti").select(columns).unionByName(split.select(columns))
    )


def _differing(texts: DataFrame) -> DataFrame:
    """Digests with a row whose bytes differ from those of the row that stays.
    A large group is spread: its kept text is replicated once per
    ``COPIES_PER_CHECK`` rows and each row meets one replica."""
    parts = F.ceil(F.col("group_size") / COPIES_PER_CHECK).cast("int")
    stays = F.struct("id", "file", "row") == F.col("keep")
    kept = texts.where(stays).select(
        "digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("text").alias("kept_text")
    )
    others = texts.where(~stays).select("digest", F.pmod(F.xxhash64("file", "row"), parts).cast("int").alias("part"), "text")
    return others.join(kept, ["digest", "part"]).where("text != kept_text").select("digest").distinct()


def _decisions(df: DataFrame) -> DataFrame:
    return df.select(
        "id", F.col("keep.id").alias("keep_id"), "group_size",
        F.struct("id", "file", "row").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256", "file", "row",
    )


def kept_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    docs = from_files(Work(spark, "exact-dedup-input"), docs)
    drop = exact_dedup(spark, docs, id_col, text_col).where(~F.col("kept")).select(
        F.col("file").alias("_drop_file"), F.col("row").alias("_drop_row")
    )
    meta = docs.metadataColumn("_metadata")
    return docs.join(
        drop, (meta["file_path"] == F.col("_drop_file")) & (meta["row_index"] == F.col("_drop_row")), "left_anti"
    )
