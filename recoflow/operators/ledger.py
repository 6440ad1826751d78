"""A resumable grid search: one written row per (setting, fold).

A grid of settings times folds is many model fits. Each finished fit writes its score to a
folder of its own, so a restart (a lost driver, a larger grid, more folds' worth of time) fits only
what is not there yet. Scores belong to the data they were measured on: the ledger's folder is
named by a digest of the rows, the seed and the ALS blocks, so other data start afresh.
With ``keep_factors`` the fitted factors are written too, and ``recount`` scores every
fold from them without MLlib's prediction or evaluator.

Defined results: a fold none of whose pairs has a known user and item has a null score and is left
out of its setting's mean; a setting without any score has a null mean and sorts last; equal
scores sort by setting; an empty table has null scores only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.config import ALS_BLOCK_SIZE, SEED
from recoflow.operators import als as als_ops
from recoflow.sources.files import folders, join

SETTING = ["maxIter", "regParam", "rank"]
SCORES = "cell string, maxIter int, regParam double, rank int, fold int, n_pairs long, rmse double"
FACTORS = "cell string, fold int, id int, features array<float>"


class GridLedger:
    """Scores under ``path`` of ALS settings on (user_id, item_id, frequency, ``fold_col``)."""

    def __init__(
        self, spark: SparkSession, path: str, data: DataFrame, fold_col: str, num_folds: int, seed: int = SEED,
        num_user_blocks: int | None = None, num_item_blocks: int | None = None, keep_factors: bool = False,
    ):
        self.spark, self.num_folds, self.seed, self.keep_factors = spark, num_folds, seed, keep_factors
        self.blocks = {"num_user_blocks": num_user_blocks, "num_item_blocks": num_item_blocks}
        self.data = data.select("user_id", "item_id", "frequency", F.col(fold_col).cast("int").alias("fold"))
        self.base = join(path, self._state())

    def _state(self) -> str:
        """A digest of the rows that does not depend on their order."""
        hashed = F.xxhash64("user_id", "item_id", "frequency", "fold")
        again = F.xxhash64(F.lit(1), "fold", "frequency", "item_id", "user_id")
        row = self.data.agg(
            F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)")), F.sum(again.cast("decimal(38,0)")),
            F.count(F.when(F.col("fold").between(0, self.num_folds - 1), 1)),
        ).first()
        if row[0] != row[3]:
            raise ValueError(f"{row[0] - row[3]} rows lie in no fold from 0 to {self.num_folds - 1}")
        self.blocks = {**als_ops.blocks(row[0], **self.blocks), "block_size": ALS_BLOCK_SIZE}
        parts = [*row, self.num_folds, self.seed, self.keep_factors, sorted(self.blocks.items())]
        return hashlib.sha256(repr([str(p) for p in parts]).encode()).hexdigest()

    def _scores(self) -> DataFrame:
        if not folders(self.spark, join(self.base, "scores")):
            return self.spark.createDataFrame([], SCORES)
        return self.spark.read.schema(SCORES).parquet(join(self.base, "scores/*"))

    def _cells(self, max_iters: Sequence[int], reg_params: Sequence[float], ranks: Sequence[int]) -> DataFrame:
        rows = [(int(i), float(g), int(r), f) for i, g, r, f in product(max_iters, reg_params, ranks, range(self.num_folds))]
        named = [(f"iter{i}_reg{g!r}_rank{r}_fold{f}", i, g, r, f) for i, g, r, f in rows]
        return self.spark.createDataFrame(named, "cell string, maxIter int, regParam double, rank int, fold int").dropDuplicates(["cell"])

    def fill(self, max_iters: Sequence[int], reg_params: Sequence[float], ranks: Sequence[int], parallelism: int = 4) -> int:
        """Fit and score the (setting, fold) cells that the ledger lacks; returns how many.
        ``parallelism`` fits, each a distributed job, run at the same time."""
        # One row per setting and fold reaches the driver, which starts the fits.
        lacking = self._cells(max_iters, reg_params, ranks).join(self._scores(), "cell", "left_anti").orderBy("fold", *SETTING).collect()
        if not lacking:
            return 0
        als_ops.use_cluster_checkpoint_dir(self.spark)
        data = self.data.repartition(self.blocks["num_user_blocks"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                for fit in [pool.submit(self._fit, data, cell) for cell in lacking]:
                    fit.result()
        finally:
            data.unpersist()
        return len(lacking)

    def _fit(self, data: DataFrame, cell) -> None:
        train, test = data.where(F.col("fold") != cell["fold"]), data.where(F.col("fold") == cell["fold"])
        n, rmse = 0, None
        if not train.isEmpty():
            model = als_ops.fit_als(
                train, rank=cell["rank"], max_iter=cell["maxIter"], reg_param=cell["regParam"], seed=self.seed, **self.blocks
            )
            error = F.col("frequency") - F.col("prediction")
            n, rmse = model.transform(test).agg(F.count(F.lit(1)), F.sqrt(F.avg(error * error))).first()
            if self.keep_factors:
                for side, factors in (("users", model.userFactors), ("items", model.itemFactors)):
                    factors.select(F.lit(cell["cell"]).alias("cell"), F.lit(cell["fold"]).alias("fold"), "id", "features").write.mode(
                        "overwrite").parquet(join(self.base, f"factors/{side}/{cell['cell']}"))
        # The score comes last: what has one is complete.
        row = (cell["cell"], cell["maxIter"], cell["regParam"], cell["rank"], cell["fold"], n, rmse)
        self.spark.createDataFrame([row], SCORES).coalesce(1).write.mode("overwrite").parquet(join(self.base, f"scores/{cell['cell']}"))

    def scores(self, max_iters: Sequence[int], reg_params: Sequence[float], ranks: Sequence[int]) -> DataFrame:
        """(cell, maxIter, regParam, rank, fold, n_pairs, rmse): the written rows of these settings."""
        return self._scores().join(self._cells(max_iters, reg_params, ranks).select("cell"), "cell", "left_semi")

    def search(self, max_iters: Sequence[int], reg_params: Sequence[float], ranks: Sequence[int], parallelism: int = 4) -> DataFrame:
        """(maxIter, regParam, rank, rmse): mean over the folds, best first; lacking cells are fitted first."""
        self.fill(max_iters, reg_params, ranks, parallelism)
        means = self.scores(max_iters, reg_params, ranks).groupBy(*SETTING).agg(F.avg("rmse").alias("rmse"))
        return means.orderBy(F.col("rmse").asc_nulls_last(), *SETTING)

    def recount(self, max_iters: Sequence[int], reg_params: Sequence[float], ranks: Sequence[int]) -> DataFrame:
        """(cell, n_pairs, rmse) by definition: held-out pairs joined with the written factors. All settings of
        a fold share its pairs, so a pair meets the vectors of all of them at once and is dealt once a side."""
        wanted = self._cells(max_iters, reg_params, ranks).select("cell", F.xxhash64("cell").alias("key"))

        def side(name: str, id_col: str, vectors: str) -> DataFrame:
            table = self.spark.read.schema(FACTORS).parquet(join(self.base, f"factors/{name}/*")).join(F.broadcast(wanted), "cell")
            by_key = F.map_from_entries(F.collect_list(F.struct("key", "features")))
            return table.groupBy("fold", F.col("id").alias(id_col)).agg(by_key.alias(vectors))

        pairs = self.data.join(side("users", "user_id", "_us"), ["fold", "user_id"]).join(side("items", "item_id", "_is"), ["fold", "item_id"])
        pairs = pairs.select("frequency", "_is", F.explode("_us").alias("key", "_u")).withColumn("_i", F.try_element_at("_is", F.col("key"))).where("_i is not null")
        product_ = F.zip_with("_u", "_i", lambda x, y: x.cast("double") * y)
        error = F.col("frequency") - F.aggregate(product_, F.lit(0.0), lambda s, x: s + x)
        scored = pairs.select("key", (error * error).alias("_e")).groupBy("key").agg(F.count(F.lit(1)).alias("n_pairs"), F.sqrt(F.avg("_e")).alias("rmse"))
        return scored.join(F.broadcast(wanted), "key").select("cell", "n_pairs", "rmse")
