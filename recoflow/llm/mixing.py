"""Mixing sources to target weights with hash-threshold histograms (operator 5,
DataFrame functions only).

Every row gets a 64-bit hash of its id. A source's budget of tokens is met by
taking all rows whose hash lies under a threshold, so nothing is sorted: token
sums by (source, hash bucket) give the bucket in which the budget ends, and only
that bucket's rows are summed again by the next hash bits, until a boundary bucket
holds one hash value. The nested thresholds then filter the rows.

A source whose target is above its size is repeated: every row is taken
``floor(target / size)`` times and the threshold decides the rest.

Defined results: a null text has size 0; null sources are one source, last in
order; empty sources and tables are taken as they are (nothing); rows with equal
ids share one hash and are decided alike; the row at the threshold is taken if
that brings the source nearer to its target; reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recoflow.llm.common import WORD, Work

#: Hash bits a histogram level refines by; six levels use up 60 of 64 bits.
BITS = 10
LEVELS = 6
SOURCE_PARTS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(work: Work, df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 0 in global order, in two passes: range-partitioned
    rows number themselves, then the partitions' counts shift the numbers."""
    local = work.keep(
        df.repartitionByRange(SOURCE_PARTS, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.join(
        counts.select(F.col("_part").alias("_p"), F.col("_n").alias("_m")), F.col("_p") < F.col("_part"), "left"
    ).groupBy("_part").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_pos")).drop(
        "_part", "_pos", "_at", "_before"
    )


def source_targets(work: Work, sizes: DataFrame, weights: Sequence[float], repeat_limit: int) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code
    point; a target stops at ``repeat_limit`` times its source's size and the
    excess is shared by weight among the others until none is above."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = (F.col("source").isNull(), F.col("source"))
    listed = ranked(work, sources, *[c.asc() for c in order])
    weight = F.array(*[F.lit(float(w)) for w in weights])
    listed = work.keep(
        listed.select(
            "source", "source_size", (F.col("source_size") * repeat_limit).cast("double").alias("cap"),
            F.get(weight, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight"),
        ),
        "sources",
    )
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        row = listed.agg(
            F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break
        raised = (total - (row["cap"] or 0.0)) / row["weight"]
        if raised <= level:
            break
        level = raised
    return listed.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1).cast("int")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    repeat_limit: int = 3,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken."""
    work = Work(spark, "mix")
    sizes = work.keep(
        docs.select(
            docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"),
            word_count(docs[text_col]).alias("size"), F.xxhash64(docs[id_col]).alias("hash"),
        ),
        "sizes",
    )
    targets = work.keep(
        source_targets(work, sizes, weights, repeat_limit).withColumns({
            "copies": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
        }).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")),
        "targets",
    )
    # A row of ``open`` is a hash interval of one source in which a budget ends.
    open_ = targets.select("source", "budget", *[F.lit(-1).alias(f"b{i}") for i in range(LEVELS)])
    decided = None  # (source, b0.., depth, extra): intervals that are taken or left whole
    for level in range(LEVELS):
        prefix = [f"b{i}" for i in range(level)]
        here = sizes.select("source", "size", "hash", *[_bucket(i).alias(f"b{i}") for i in range(level + 1)])
        if level:  # only rows of boundary buckets are summed again
            here = here.join(open_.select("source", *prefix), _same("source", here, open_) & _equal(prefix, here, open_), "left_semi")
        sums = here.groupBy("source", *prefix, f"b{level}").agg(
            F.sum("size").alias("tokens"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        parents = open_.select(F.col("source").alias("_s"), "budget", *[F.col(c).alias(f"_{c}") for c in prefix])
        cond = F.col("source").eqNullSafe(F.col("_s"))
        for c in prefix:
            cond &= F.col(c) == F.col(f"_{c}")
        w = Window.partitionBy("source", *prefix).orderBy(f"b{level}")
        cum = sums.join(parents, cond).drop("_s", *[f"_{c}" for c in prefix]).withColumn("until", F.sum("tokens").over(w))
        before = F.col("until") - F.col("tokens")
        whole = F.col("until") <= F.col("budget")
        single = (F.col("lo") == F.col("hi")) if level < LEVELS - 1 else F.lit(True)
        nearer = F.col("budget") - before > F.col("until") - F.col("budget")
        ends = (F.col("until") > F.col("budget")) & (before < F.col("budget"))
        cum = work.keep(
            cum.withColumns({
                "state": F.when(whole, 1).when(ends & ~single, 2).when(ends & nearer, 1).otherwise(0),
                "budget": F.col("budget") - before,
            }),
            f"level{level}",
        )
        found = cum.where("state < 2").select(
            "source", *prefix, f"b{level}", *[F.lit(-1).alias(f"b{i}") for i in range(level + 1, LEVELS)],
            F.col("state").alias("extra"),
        )
        decided = found if decided is None else decided.unionByName(found)
        open_ = cum.where("state = 2").select("source", "budget", *prefix, f"b{level}")
        if open_.isEmpty():
            break
    # Each row finds its interval: one equi-join per level used, spread over the buckets.
    out = sizes.withColumns({f"b{i}": _bucket(i) for i in range(level + 1)}).withColumn("extra", F.lit(None).cast("int"))
    for depth in range(level + 1):
        keys = [f"b{i}" for i in range(depth + 1)]
        at_depth = decided.where((F.col(f"b{depth}") >= 0) & (F.col(f"b{depth + 1}") < 0 if depth + 1 < LEVELS else F.lit(True)))
        at_depth = at_depth.select(F.col("source").alias("_s"), *[F.col(c).alias(f"_{c}") for c in keys], F.col("extra").alias("_extra"))
        cond = F.col("source").eqNullSafe(F.col("_s"))
        for c in keys:
            cond &= F.col(c) == F.col(f"_{c}")
        out = out.join(at_depth, cond, "left").withColumn("extra", F.coalesce("extra", "_extra")).drop(
            "_s", "_extra", *[f"_{c}" for c in keys]
        )
    out = out.drop(*[f"b{i}" for i in range(level + 1)])
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target", F.col("copies").alias("_whole"))
    return out.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(
        "id", "source", "size", "source_size", "target",
        (F.col("_whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"),
    ).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns."""
    taken = mix(spark, docs, id_col, text_col, source_col, **how).where("copies > 0").select(
        F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies")
    ).distinct()
    same = docs[id_col].eqNullSafe(taken["_mix_id"]) & docs[source_col].cast("string").eqNullSafe(taken["_mix_source"])
    return docs.join(taken.hint("merge"), same).withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))
    ).select(*[docs[c] for c in docs.columns])


def _same(col: str, a: DataFrame, b: DataFrame) -> Column:
    return a[col].eqNullSafe(b[col])


def _equal(cols: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in cols:
        out &= a[c] == b[c]
    return out
