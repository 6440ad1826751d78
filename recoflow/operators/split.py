"""Exact temporal split by row rank, without a one-partition sort.

The reference sorts the whole history and slices rows ``[:int(.7n)]``,
``[int(.7n):int(.7n)+int(.2n)]`` and the rest. A global sort + limit funnels
70 % of the rows through one task, and so does an unpartitioned
``row_number``. Here the cut is found as a *key threshold* instead, one way
for every size and every orderable key type:

1. Count rows per value of the leading key (a partial + final hash
   aggregate, so a hot timestamp holding a third of the rows is folded on
   the map side before the shuffle).
2. Range-partition the counts, sum them per partition (one row per partition
   reaches the driver), and number only the partition that holds the cut: a
   running sum there gives the boundary value.
3. If the cut falls inside the rows of one leading value, do the same over
   the distinct rows of that value, ordered by the remaining key columns and
   then by all other columns.

Rows that are equal in every column are interchangeable: if the cut falls
among such copies, the slices take exactly as many of them as each needs.
Nulls sort first. The slices are plain range filters (``lex_le``), evaluated
row-locally in every partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflow.config import TEST_FRACTION, TRAIN_FRACTION
from recoflow.functions.keys import encoded, lex_le, prefix_eq

#: Copies of one row that a task writes out when a cut falls among copies.
COPIES_PER_ROW = 10_000


@dataclass(frozen=True)
class Cut:
    """A threshold over a composite key: ``kind`` is "none" (no rows),
    "all" (every row) or "prefix" (rows with key[:len(values)] <= values).
    If ``take < of``, the cut lies among ``of`` equal rows, ``take`` of them
    below it."""

    kind: str
    cols: tuple = ()
    values: tuple = ()
    kinds: tuple = ()
    take: int = 0
    of: int = 0

    @property
    def among_copies(self) -> bool:
        return self.take < self.of

    def le(self) -> Column:
        """Rows up to the cut; all of the copies if it lies among some."""
        if self.kind == "none":
            return F.lit(False)
        if self.kind == "all":
            return F.lit(True)
        return lex_le(self.cols, self.values, self.kinds)

    def copies(self) -> Column:
        return prefix_eq(self.cols, self.values, self.kinds) if self.among_copies else F.lit(False)


def _value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))


def _boundaries(counts: DataFrame, cols: Sequence[str], ranks: Sequence[int]) -> list[tuple[tuple, int, int]]:
    """For each rank (1-based) the key holding it, given rows (cols, _n):
    (encoded key, rows before it, rows at it)."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [counts.schema[c].dataType.simpleString() for c in cols]
    dealt = counts.select(*cols, "_n").repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _find(dealt, cols, kinds, ranks)
    finally:
        dealt.unpersist()


def _find(dealt: DataFrame, cols: Sequence[str], kinds: Sequence[str], ranks: Sequence[int]) -> list[tuple[tuple, int, int]]:
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_n")).orderBy("_part").collect()  # one row per partition
    wanted, base = {}, 0
    for s in sums:
        for rank in ranks:
            if base < rank <= base + s["_n"]:
                wanted[rank] = (s["_part"], base)
        base += s["_n"]
    running = F.sum("_n").over(Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0))
    numbered = dealt.where(F.col("_part").isin(sorted({p for p, _ in wanted.values()}))).withColumn("_until", running)
    hit = F.lit(False)
    for rank, (part, before) in wanted.items():
        hit = hit | ((F.col("_part") == part) & (F.col("_until") >= rank - before) & (F.col("_until") - F.col("_n") < rank - before))
    keys = [encoded(c, k).alias(f"_k{i}") for i, (c, k) in enumerate(zip(cols, kinds))]
    rows = numbered.where(hit).select("_part", "_until", "_n", *keys).collect()  # one row per rank
    out = []
    for rank in ranks:
        part, before = wanted[rank]
        r = next(r for r in rows if r["_part"] == part and r["_until"] - r["_n"] < rank - before <= r["_until"])
        out.append((tuple(r[f"_k{i}"] for i in range(len(cols))), before + r["_until"] - r["_n"], r["_n"]))
    return out


def locate_ranks(
    df: DataFrame, order_cols: Sequence[str], ms: Sequence[int], n: int, first_counts: DataFrame | None = None,
    rows_at: Callable[[Column, int], DataFrame] | None = None,
) -> list[Cut]:
    """For each m, the cut with exactly m of the n rows of ``df`` up to it, in
    ``order_cols`` order (ties by the other columns). The rows of all leading values that
    hold a cut are found in one pass: ``df`` under a condition on its leading column, or
    ``rows_at(condition, rows)`` of a caller that finds so many rows of ``df`` more cheaply."""
    lead, kinds = order_cols[0], {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rest = [*order_cols[1:], *[c for c in df.columns if c not in order_cols]]
    inner = sorted({m for m in ms if 0 < m < n})
    counts = first_counts if first_counts is not None else _value_counts(df, [lead])
    found: dict[int, Cut] = {}
    inside: dict[tuple, list[tuple[int, int]]] = {}
    sizes: dict[tuple, int] = {}
    for m, (value, before, at) in zip(inner, _boundaries(counts, [lead], inner) if inner else []):
        if before + at == m or not rest:
            found[m] = Cut("prefix", (lead,), value, (kinds[lead],), m - before, at)
        else:
            inside.setdefault(value, []).append((m, m - before))
            sizes[value] = at
    if inside:
        conditions = {value: prefix_eq([lead], value, [kinds[lead]]) for value in inside}
        among = reduce(Column.__or__, conditions.values())
        rows = rows_at(among, sum(sizes.values())) if rows_at else df.where(among)
        groups = _value_counts(rows, [lead, *rest]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for value, ranks in inside.items():
                at = _boundaries(groups.where(conditions[value]), rest, [r for _, r in ranks])
                for (m, r), (values, before, copies) in zip(ranks, at):
                    cols = (lead, *rest)
                    found[m] = Cut("prefix", cols, value + values, tuple(kinds[c] for c in cols), r - before, copies)
        finally:
            groups.unpersist()
    return [Cut("none") if m <= 0 else Cut("all") if m >= n else found[m] for m in ms]


def locate_rank(df: DataFrame, order_cols: Sequence[str], m: int, n: int, first_counts: DataFrame | None = None) -> Cut:
    return locate_ranks(df, order_cols, [m], n, first_counts)[0]


def _repeat(df: DataFrame, cut: Cut, times: int) -> DataFrame:
    """``times`` copies of the row that the cut's copies all equal."""
    block, left = F.col("_block"), F.lit(times) - F.col("_block") * COPIES_PER_ROW
    return (
        df.where(cut.copies()).limit(1)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((times - 1) // COPIES_PER_ROW))))
        .repartition(block)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(left, F.lit(COPIES_PER_ROW)))))
        .select(*df.columns)
    )


def rows_between(df: DataFrame, low: Cut, high: Cut) -> DataFrame:
    """The rows above ``low`` and up to ``high``."""
    out = df.where(high.le() & ~low.le() & ~high.copies())
    same = low.among_copies and high.among_copies and low.values == high.values
    if same:
        return out.unionByName(_repeat(df, high, high.take - low.take)) if high.take > low.take else out
    if low.among_copies:
        out = out.unionByName(_repeat(df, low, low.of - low.take))
    if high.among_copies:
        out = out.unionByName(_repeat(df, high, high.take))
    return out


@dataclass(frozen=True)
class TemporalSplit:
    """Row counts and key thresholds of the train / test / validation slices.
    The slices are taken from the frame the split was computed on."""

    cols: tuple
    n: int
    n_train: int
    n_test: int
    train_cut: Cut
    test_cut: Cut

    def train(self, df: DataFrame) -> DataFrame:
        return rows_between(df, Cut("none"), self.train_cut)

    def train_test(self, df: DataFrame) -> DataFrame:
        return rows_between(df, Cut("none"), self.test_cut)

    def test(self, df: DataFrame) -> DataFrame:
        return rows_between(df, self.train_cut, self.test_cut)

    def validation(self, df: DataFrame) -> DataFrame:
        return rows_between(df, self.test_cut, Cut("all"))

    def labelled(self, df: DataFrame, name: str = "slice") -> DataFrame:
        """``df`` with the slice of every row."""
        if self.train_cut.among_copies or self.test_cut.among_copies:
            parts = [(self.train(df), "train"), (self.test(df), "test"), (self.validation(df), "validation")]
            first, *others = [p.withColumn(name, F.lit(label)) for p, label in parts]
            for p in others:
                first = first.unionByName(p)
            return first
        label = F.when(self.train_cut.le(), F.lit("train")).when(self.test_cut.le(), F.lit("test")).otherwise(F.lit("validation"))
        return df.withColumn(name, label)


def slice_sizes(n: int, train_fraction: float = TRAIN_FRACTION, test_fraction: float = TEST_FRACTION):
    """``int(n*0.7)``, ``int(n*0.2)`` in double arithmetic (n=90 gives 62)."""
    return int(n * train_fraction), int(n * test_fraction)


def temporal_split(
    history: DataFrame,
    order_cols: Sequence[str],
    train_fraction: float = TRAIN_FRACTION,
    test_fraction: float = TEST_FRACTION,
    leading_counts: DataFrame | None = None,
    rows_at: Callable[[Column, int], DataFrame] | None = None,
) -> TemporalSplit:
    """Compute the exact 70 / 20 / rest cut of ``history`` in ``order_cols`` order.

    ``leading_counts`` (columns: the leading key, ``_n``) may be supplied when
    the caller can count rows per leading-key value more cheaply than by
    scanning ``history`` (e.g. pre-aggregated before a join); ``rows_at`` as in ``locate_ranks``.
    """
    cols = tuple(order_cols)
    counts = leading_counts if leading_counts is not None else _value_counts(history, [cols[0]])
    counts = counts.select(cols[0], "_n").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
        n_train, n_test = slice_sizes(n, train_fraction, test_fraction)
        train_cut, test_cut = locate_ranks(history, cols, [n_train, n_train + n_test], n, counts, rows_at)
    finally:
        counts.unpersist()
    return TemporalSplit(cols, n, n_train, n_test, train_cut, test_cut)
