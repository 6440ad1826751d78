"""The resumable grid ledger, and clustering on weighted profiles."""

import math
from itertools import product

import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from recoflow import session
from recoflow.operators import als as als_ops
from recoflow.operators import clustering as cl
from recoflow.operators import features as feat
from recoflow.operators import folds
from recoflow.operators.ledger import FACTORS, GridLedger
from recoflow.plans import checks
from recoflow.plans.inputs import Inputs
from recoflow.plans.recommender import HybridRecommender

SF = "/root/testdata/sf0.001"
GRID = {"max_iters": [2], "reg_params": [0.1, 1.0], "ranks": [2, 3]}


@pytest.fixture(scope="module")
def data(spark):
    return folds.assign_folds(Inputs(spark, SF).train_freqs, 2).persist()


def ledger(spark, path, data, **kw):
    return GridLedger(spark, str(path), data, "fold", 2, **kw)


def test_scores_are_those_of_cross_validation(spark, data, tmp_path):
    own = ledger(spark, tmp_path, data, keep_factors=True)
    got = own.search(**GRID).collect()
    want = als_ops.grid_search(spark, data, "fold", 2, GRID["max_iters"], GRID["reg_params"], GRID["ranks"]).collect()
    key = lambda r: (r.maxIter, r.regParam, r.rank)
    want = {key(r): r.rmse for r in want}
    assert [key(r) for r in got] == sorted(want, key=want.get)
    assert all(r.rmse == pytest.approx(want[key(r)], rel=1e-6) for r in got)
    counted = {r.cell: (r.n_pairs, pytest.approx(r.rmse, rel=1e-6)) for r in own.recount(**GRID).collect()}
    assert {r.cell: (r.n_pairs, r.rmse) for r in own.scores(**GRID).collect()} == counted and len(counted) == 8


def test_a_restart_fits_what_is_lacking(spark, data, tmp_path, monkeypatch):
    fitted, fit = [], als_ops.fit_als

    def stops_after_three(*args, **kw):
        if len(fitted) == 3:
            raise RuntimeError("lost")
        fitted.append(kw)
        return fit(*args, **kw)

    monkeypatch.setattr(als_ops, "fit_als", stops_after_three)
    with pytest.raises(RuntimeError, match="lost"):
        ledger(spark, tmp_path, data).fill(**GRID, parallelism=1)
    monkeypatch.setattr(als_ops, "fit_als", fit)
    again = ledger(spark, tmp_path, data.repartition(3))  # the same rows, dealt differently
    assert again.fill(**GRID) == 5 and again.fill(**GRID) == 0
    wider = {**GRID, "max_iters": [2, 3]}
    assert again.search(**GRID).count() == 4 and again.fill(**wider) == 8
    # other rows, folds or seeds are another ledger
    other = data.withColumn("frequency", F.col("frequency") + F.when(F.rand(1) < 0.01, 1).otherwise(0))
    assert ledger(spark, tmp_path, other).scores(**GRID).count() == 0
    assert ledger(spark, tmp_path, data, seed=1).scores(**GRID).count() == 0


def test_folds_without_known_pairs(spark, tmp_path):
    schema = "user_id int, item_id int, frequency double, fold int, cell string, extra int"
    one = spark.createDataFrame([(1, 1, 2.0, 0, "x", 1), (1, 2, 2.0, 0, "x", 1), (2, 1, 1.0, 0, "x", 1), (1, 1, 1.0, 1, "x", 1)], schema)
    small = {"max_iters": [1], "reg_params": [0.1], "ranks": [1]}
    rows = {r.fold: r for r in (lambda g: (g.fill(**small), g.scores(**small).collect())[1])(ledger(spark, tmp_path, one))}
    assert (rows[0].n_pairs, rows[1].n_pairs) == (1, 1)
    alone = spark.createDataFrame([(1, 1, 2.0, 0, "x", 1), (2, 2, 2.0, 1, "x", 1)], schema)
    assert [r.rmse for r in ledger(spark, tmp_path, alone).search(**small).collect()] == [None]
    empty = ledger(spark, tmp_path, one.limit(0)).search(**small).collect()
    assert [(r.maxIter, r.rmse) for r in empty] == [(1, None)]
    with pytest.raises(ValueError, match="1 rows lie in no fold"):
        ledger(spark, tmp_path, one.withColumn("fold", F.col("fold") * 2))


def test_profile_scores_by_definition(spark):
    """Weighted profiles against the silhouette over all pairs of users."""
    users = Inputs(spark, SF).users
    twice = users.unionByName(users.where("user_id % 3 = 0")).unionByName(users.where("user_id = 1"))
    model = feat.fit_features(twice)
    points = cl.profiles(twice, model).persist()
    assert points.agg(F.sum("weight")).first()[0] == twice.count() and points.count() < twice.count()
    for k in (2, 7, 120):
        fitted = cl.fit_profiles(points, k)
        assigned = fitted.transform(points)
        rows = [(tuple(r.features.toArray()), r.prediction) for r in assigned.collect() for _ in range(int(r.weight))]
        assert cl.profile_silhouette(assigned) == pytest.approx(brute(rows), abs=1e-9)
        assert cl.profile_silhouette(assigned) == pytest.approx(cl.silhouette(model.transform(twice), fitted), abs=1e-9)
    assert cl.profile_silhouette(cl.fit_profiles(points, 1 + 1).transform(points).withColumn("prediction", F.lit(0))) is None


def brute(rows):
    groups = {}
    for x, c in rows:
        groups.setdefault(c, []).append(x)
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    seen, total = {}, 0.0
    for x, c in rows:
        if (x, c) not in seen:
            near = sum(distance(x, y) for y in groups[c]) / max(len(groups[c]) - 1, 1)
            far = min(sum(distance(x, y) for y in g) / len(g) for o, g in groups.items() if o != c)
            seen[x, c] = 0.0 if len(groups[c]) == 1 or max(near, far) == 0 else (far - near) / max(near, far)
        total += seen[x, c]
    return total / len(rows)


def test_weighted_fit_has_the_objective_of_all_users(spark):
    """The weighted cost is the cost over all users, and centres are the means of their users."""
    users = Inputs(spark, SF).users
    both = users.unionByName(users.where("user_id % 2 = 0"))
    model = feat.fit_features(both)
    points = cl.profiles(both, model).persist()
    fitted: KMeansModel = cl.fit_profiles(points, 6, max_iter=100)
    vectors = model.transform(both)
    cost, sums, n = 0.0, {}, {}
    for r in fitted.transform(vectors).select("features", "prediction").collect():
        x, c = r.features.toArray(), r.prediction
        cost += float(((x - fitted.clusterCenters()[c]) ** 2).sum())
        sums[c], n[c] = sums.get(c, 0) + x, n.get(c, 0) + 1
    assert math.isclose(fitted.summary.trainingCost, cost, rel_tol=1e-6)
    for c, i in product(sums, range(2)):
        assert fitted.clusterCenters()[c][i] == pytest.approx(sums[c][i] / n[c], abs=1e-3)


def test_the_check_recounts_once(spark, data, tmp_path):
    """A recount is a pass over all pairs: the check's aggregates share its rows."""
    own = ledger(spark, tmp_path, data, keep_factors=True)
    result, scores, seen = own.search(**GRID), own.scores(**GRID), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    recount = own.recount(**GRID)
    row = checks.grid(result, scores, recount.mapInPandas(count, recount.schema)).first()
    assert seen.value == 8
    assert (row.n_settings, row.n_wrong_pairs, row.n_wrong_rmse, row.n_wrong_mean) == (4, 0, 0, 0)


def test_recount_takes_pairs_known_to_each_model(spark, data, tmp_path):
    """Pairs meet all settings' vectors at once; one whose item a single model lacks is left out of that cell only."""
    own = ledger(spark, tmp_path, data, keep_factors=True)
    own.fill(**GRID)
    full = {r.cell: r.n_pairs for r in own.recount(**GRID).collect()}
    one = min(full)
    path = f"{own.base}/factors/items/{one}"
    rows = spark.read.parquet(path).collect()
    spark.createDataFrame(rows[: len(rows) // 2], FACTORS).write.mode("overwrite").parquet(path)
    less = {r.cell: r.n_pairs for r in own.recount(**GRID).collect()}
    assert less[one] < full[one] and {c: n for c, n in less.items() if c != one} == {c: n for c, n in full.items() if c != one}
    # One row per pair goes into the joins, not one per pair and setting.
    assert own.recount(**GRID)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_blocks_grow_with_the_ratings(spark, data, monkeypatch):
    """Before, two item blocks at any size: half of all ratings in one task's memory."""
    monkeypatch.setattr(als_ops.config, "ALS_BLOCK_RATINGS", 20_000_000)
    assert als_ops.blocks(25_000_000) == {"num_user_blocks": 10, "num_item_blocks": 2}
    assert als_ops.blocks(150_000_000) == {"num_user_blocks": 10, "num_item_blocks": 8}
    assert als_ops.blocks(900_000_000, 3, 4) == {"num_user_blocks": 3, "num_item_blocks": 4}
    n = data.count()
    monkeypatch.setattr(als_ops.config, "ALS_BLOCK_RATINGS", -(-n // 5))
    model = als_ops.fit_als(data, rank=2, max_iter=1)
    assert (model.itemFactors.rdd.getNumPartitions(), model.userFactors.rdd.getNumPartitions()) == (5, 10)
    own = ledger(spark, "/nowhere", data)
    assert (own.blocks["num_user_blocks"], own.blocks["num_item_blocks"]) == (10, 5)
    rec = HybridRecommender(k_clusters=2, rank=2, max_iter=1, top_k=3).fit_als(data)
    assert '"num_item_blocks": 5' in rec.settings()


def test_shuffle_files_of_fits_go_while_others_run(spark, data, tmp_path, monkeypatch):
    """Before, those of all fits stayed until the driver happened to collect its garbage."""
    kept = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    seen, fit = [], als_ops.fit_als

    def counted(*args, **kw):
        seen.append(kept())
        return fit(*args, **kw)

    monkeypatch.setattr(als_ops, "fit_als", counted)
    monkeypatch.setattr(session, "RELEASE_EVERY", 0.0)
    data.count()
    ledger(spark, tmp_path, data).fill(**{**GRID, "max_iters": [2, 6]}, parallelism=1)
    # A fit of six iterations writes some twenty shuffles.
    assert len(seen) == 16 and seen[-1] < seen[0] + 60
