"""Golden values and hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recoflow.functions.ranking import ideal_dcg
from recoflow.operators import evaluation as ev
from recoflow.operators import history as hist
from recoflow.operators import truth as tr
from recoflow.operators.merge import merge_lists
from recoflow.operators.split import locate_rank, slice_sizes, temporal_split

K = 72


def lists_frame(spark, rows):
    return spark.createDataFrame(rows, "user_id int, items array<int>")


def truth_frame(spark, rows):
    return spark.createDataFrame(rows, "user_id int, item_id int")


# -- metrics goldens -------------------------------------------------------------

def test_ideal_dcg_72():
    assert ideal_dcg(72) == pytest.approx(16.592344975910464, abs=1e-12)


def test_ndcg_all_relevant_is_one(spark):
    lists = lists_frame(spark, [(1, list(range(100, 172)))])
    truth = truth_frame(spark, [(1, i) for i in range(100, 172)])
    got = ev.ndcg_per_user(ev.full_lists(lists), truth).first()["ndcg"]
    assert got == pytest.approx(1.0, abs=1e-12)


def test_ndcg_first_hit_only(spark):
    lists = lists_frame(spark, [(1, list(range(100, 172)))])
    truth = truth_frame(spark, [(1, 100), (1, 5)])
    got = ev.ndcg_per_user(ev.full_lists(lists), truth).first()["ndcg"]
    assert got == pytest.approx(0.060268756553208506, abs=1e-12)


def test_entropy_same_and_disjoint(spark):
    same = lists_frame(spark, [(1, list(range(72))), (2, list(range(72)))])
    disjoint = lists_frame(spark, [(1, list(range(72))), (2, list(range(72, 144)))])
    e1 = ev.entropy_at_k(same).first()["entropy"]
    e2 = ev.entropy_at_k(disjoint).first()["entropy"]
    assert e1 == pytest.approx(math.log2(72), abs=1e-9)
    assert e2 == pytest.approx(math.log2(144), abs=1e-9)


def test_short_list_dropped_when_require_full(spark):
    lists = lists_frame(spark, [(1, list(range(71))), (2, list(range(72)))])
    assert [r.user_id for r in ev.full_lists(lists).collect()] == [2]
    assert ev.full_lists(lists, require_full=False).count() == 2


def test_item_zero_is_not_a_padding_hit(spark):
    lists = lists_frame(spark, [(1, [0] + list(range(100, 171)))])
    truth = truth_frame(spark, [(1, 5)])
    rel = ev.relevance(ev.full_lists(lists), truth).where(F.col("item_id") == 0).first()
    assert rel["rel"] == 0


def test_duplicate_recommended_item_counts_each_time(spark):
    lists = lists_frame(spark, [(1, [7, 7] + list(range(100, 170)))])
    truth = truth_frame(spark, [(1, 7)])
    got = ev.ndcg_per_user(ev.full_lists(lists), truth).first()["ndcg"]
    assert got == pytest.approx((1 + 1 / math.log2(3)) / ideal_dcg(72), abs=1e-12)


def test_users_without_truth_skip_ndcg_but_count_for_entropy(spark):
    lists = lists_frame(spark, [(1, list(range(72))), (2, list(range(72)))])
    truth = truth_frame(spark, [(1, 3)])
    assert ev.ndcg_per_user(ev.full_lists(lists), truth).count() == 1
    assert ev.entropy_at_k(lists).first()["n_users"] == 2


def test_histogram_counts_every_user(spark):
    per_user = spark.createDataFrame([("m", 1, 0.0), ("m", 2, 0.5), ("m", 3, 1.0), ("m", 4, 0.25)], "model string, user_id int, ndcg double")
    h = ev.ndcg_histogram(per_user, bins=4).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 1, 1]
    assert h[-1].upper == pytest.approx(1.0)


# -- history ---------------------------------------------------------------------

def test_sum_per_pair(spark):
    h = spark.createDataFrame([(1, "I5", 10, 2), (1, "I5", 20, 3), (2, "I7", 10, 1)], "user_id int, item_id string, latest_timestamp bigint, frequency int")
    got = sorted(tuple(r) for r in hist.item_frequencies(h).collect())
    assert got == [(1, 5, 5.0), (2, 7, 1.0)]


@pytest.mark.parametrize("n,expected", [(10, (7, 2)), (11, (7, 2)), (90, (62, 18))])
def test_slice_sizes(n, expected):
    assert slice_sizes(n) == expected


def test_split_with_ties_is_stable_under_repartition(spark):
    rows = [(1, f"I{i}", 100, 1, i) for i in range(10)]
    h = spark.createDataFrame(rows, "user_id int, item_id string, latest_timestamp bigint, frequency int, k int")
    cols = ("latest_timestamp", "user_id", "k")
    results = []
    for parts in (1, 3, 7):
        hp = h.repartition(parts)
        s = temporal_split(hp, cols)
        labelled = s.labelled(hp).orderBy("k").select("slice").collect()
        results.append([r.slice for r in labelled])
    assert results[0] == results[1] == results[2]
    assert results[0] == ["train"] * 7 + ["test"] * 2 + ["validation"]


def _brute_cut(rows, m):
    return sorted(rows)[:m]


def test_locate_rank_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(7)
    # A third of the rows share one timestamp (a hot key).
    rows = [(500, rnd.randint(0, 40), i) for i in range(300)]
    rows += [(rnd.randint(0, 1000), rnd.randint(0, 40), 300 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "ts bigint, u int, k int").repartition(5)
    cols = ("ts", "u", "k")
    n = len(rows)
    for m in (0, 1, 299, 450, 630, 899, 900):
        cut = locate_rank(df, cols, m, n)
        got = sorted(tuple(r) for r in df.where(cut.le()).collect())
        assert got == _brute_cut(rows, m), (m, cut)


# -- truth -----------------------------------------------------------------------

def test_truth_wide_repeats_and_pads(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    rows = spark.createDataFrame([(1, "I5", 10, 2), (1, "I7", 20, 1)], "user_id int, item_id string, latest_timestamp bigint, frequency int")
    got = {r.user_id: r.items_actioned_on.split(",") for r in tr.truth_wide(users, rows, ("latest_timestamp", "user_id")).collect()}
    assert got[1] == ["5", "5", "7"] + ["0"] * 69
    assert got[2] == ["0"] * 72


def test_truth_wide_long_is_not_cut(spark):
    users = spark.createDataFrame([(1,)], "user_id int")
    rows = spark.createDataFrame([(1, "I3", 10, 50), (1, "I4", 11, 30)], "user_id int, item_id string, latest_timestamp bigint, frequency int")
    got = tr.truth_wide(users, rows, ("latest_timestamp", "user_id")).first().items_actioned_on.split(",")
    assert len(got) == 80 and got[:50] == ["3"] * 50 and got[50:] == ["4"] * 30


# -- merges ----------------------------------------------------------------------

def _merge(spark, p, s, g, k, mode):
    users = spark.createDataFrame([(1,)], "user_id int")
    prim = lists_frame(spark, [(1, p)]) if p is not None else None
    sec = lists_frame(spark, [(1, s)]) if s is not None else None
    return merge_lists(users, prim, sec, g, k, mode).first()["items"]


def test_merge_known(spark):
    assert _merge(spark, [1, 2, 3], [2, 4, 5, 6, 7], [9, 8], 6, "hybrid") == [1, 2, 3, 4, 5, 6]


def test_merge_cold(spark):
    assert _merge(spark, None, [4, 5], [5, 6, 7, 8, 9, 10], 4, "hybrid") == [4, 5, 6, 7]


def test_merge_no_cluster(spark):
    assert _merge(spark, [1, 2], None, [2, 3, 4], 4, "hybrid") == [1, 2, 3, 4]


def _reference_self_fill(k_recs, als_rec, top, K):
    k = (k_recs or [])[:K]
    if als_rec is not None:
        a = als_rec[:K]
        ret = a
        if len(ret) < K:
            ret = ret + a[len(k):]
    else:
        ret = list(k)
        if len(ret) < K:
            ret = ret + top[: K - len(ret)]
    return ret


def _reference_interleave(k_recs, als_rec, top, K):
    if als_rec is None:
        return _reference_self_fill(k_recs, als_rec, top, K)
    a, b = als_rec[:K][: K // 2], (k_recs or [])[:K][: K // 2]
    return [r for pair in zip(a, b) for r in pair]


@pytest.mark.parametrize("seed", range(6))
def test_self_fill_and_interleave_match_list_semantics(spark, seed):
    rnd = random.Random(seed)
    K = 6
    p = None if seed % 3 == 0 else rnd.sample(range(20), rnd.randint(1, 8))
    s = None if seed % 4 == 1 else rnd.sample(range(20), rnd.randint(0, 8))
    g = rnd.sample(range(20), K)
    assert _merge(spark, p, s, g, K, "self_fill") == _reference_self_fill(s, p, g, K)
    assert _merge(spark, p, s, g, K, "interleave") == _reference_interleave(s, p, g, K)


# -- options and helpers -----------------------------------------------------------

def test_ndcg_ideal_truth_matches_ranking_evaluator_definition(spark):
    lists = lists_frame(spark, [(1, list(range(100, 172)))])
    truth = truth_frame(spark, [(1, 100)])
    got = ev.ndcg_per_user(ev.full_lists(lists), truth, ideal="truth").first()["ndcg"]
    assert got == pytest.approx(1.0)


def test_duplicate_users_are_rejected(spark):
    lists = lists_frame(spark, [(1, [1]), (1, [2])])
    with pytest.raises(ValueError):
        ev.assert_unique_users(lists)


def test_first_users_is_deterministic(spark):
    from recoflow.operators.explore import first_users

    users = spark.createDataFrame([(i,) for i in range(50, 0, -1)], "user_id int").repartition(4)
    assert [r.user_id for r in first_users(users, 3).collect()] == [1, 2, 3]


def test_model_dir_naming():
    from recoflow.sinks.writers import model_dir

    assert model_dir("models", "als", maxIter=20, regParam=0.1, rank=200) == "models/als_20_01_200"


def test_broadcast_only_within_threshold(spark):
    from recoflow.operators import popularity as pop

    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    groups = spark.createDataFrame([(1, 0), (2, 1)], "user_id int, prediction int")
    lists = lists_frame(spark, [(0, [5])]).withColumnRenamed("user_id", "prediction")
    small = pop.lists_for_users(users, groups, lists, "prediction", max_groups=10, k=72)
    big = pop.lists_for_users(users, groups, lists, "prediction", max_groups=10**9, k=72)
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in big._jdf.queryExecution().analyzed().toString().lower()
    assert small.collect() == big.collect()


def test_salted_group_join_spreads_a_hot_group(spark):
    from recoflow.operators import popularity as pop

    n = 400
    users = spark.createDataFrame([(i,) for i in range(n)], "user_id int")
    # A third of the users sit in group 0, the rest spread over 1..9.
    groups = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1 + i % 9) for i in range(n)], "user_id int, g int")
    lists = spark.createDataFrame([(g, [g, g + 100]) for g in range(10)], "g int, items array<int>")
    out = pop.lists_for_users(users, groups, lists, "g", max_groups=None, salt=8)
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.user_id: list(r["items"]) for r in out.collect()}
    assert len(got) == n
    assert all(got[i] == ([0, 100] if i % 3 == 0 else [1 + i % 9, 101 + i % 9]) for i in range(n))


def test_library_only_adopts_the_cluster_checkpoint_dir(spark):
    from recoflow.session import use_cluster_checkpoint_dir

    configured = spark.conf.get("spark.checkpoint.dir")
    assert use_cluster_checkpoint_dir(spark) in (configured, spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir() is not None


def test_exploration_helpers(spark):
    from recoflow.operators import explore as ex
    from recoflow.operators import folds

    users = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "user_id int, feature1 string")
    counts = ex.sorted_value_counts(ex.feature_value_counts(users, cols=("feature1",))).collect()
    assert [(r.value, r["count"]) for r in counts] == [("a", 20), ("b", 10)]
    assert ex.preview(users, 5).count() == 5 and ex.preview(users, -1).count() == 30
    sample = spark.createDataFrame([(1,), (2,), (99,)], "user_id int")
    assert sorted(r.user_id for r in ex.restrict_users(users, sample).collect()) == [1, 2]
    parts = folds.random_split(users, [0.1, 0.5, 0.2, 0.1])
    assert len(parts) == 4 and sum(p.count() for p in parts) == 30


def test_pre_aggregated_time_counts_equal_grouping_the_history(spark):
    from recoflow.sources import tables

    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in tables.history_time_counts(spark, sf).collect())
    h = tables.item_history(spark, sf)
    b = sorted(tuple(r) for r in h.groupBy("latest_timestamp").agg(F.count(F.lit(1)).alias("_n")).collect())
    assert a == b


# -- edge cases ------------------------------------------------------------------

def test_split_of_empty_history(spark):
    h = spark.createDataFrame([], "user_id int, item_id string, latest_timestamp bigint, frequency int, k int")
    s = temporal_split(h, ("latest_timestamp", "user_id", "k"))
    assert (s.n, s.n_train, s.n_test) == (0, 0, 0)
    assert s.train_cut.kind == "none" and s.test_cut.kind == "none"
    assert s.train(h).count() == 0


def test_merge_with_empty_global_list(spark):
    assert _merge(spark, None, [3, 4], [], 4, "hybrid") == [3, 4]
    assert _merge(spark, None, None, [], 4, "hybrid") == []


def test_evaluate_without_any_truth(spark):
    lists = ev.with_model(lists_frame(spark, [(1, list(range(72)))]), "m")
    truth = truth_frame(spark, [])
    row = ev.evaluate(lists, truth).first()
    assert row.n_lists == 1 and row.n_scored is None and row.entropy == pytest.approx(math.log2(72))


def test_histogram_of_a_single_value(spark):
    per_user = spark.createDataFrame([("m", 1, 0.25), ("m", 2, 0.25)], "model string, user_id int, ndcg double")
    h = ev.ndcg_histogram(per_user, bins=5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 0, 0, 0, 0]


def test_truth_chunks_join_to_the_wide_truth(spark):
    from recoflow.operators import truth as tr

    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id int")
    rows = [(1, "I7", 5, 3), (1, "I8", 4, 2), (1, "I8", 4, 2), (2, "I1", 1, 9), (3, "I5", 1, 0), (9, "I5", 1, 4)]
    history = spark.createDataFrame(rows, "user_id int, item_id string, latest_timestamp long, frequency int")
    chunks = tr.truth_chunks(users, history, ("latest_timestamp",), k=6, chunk=4)
    got = {}
    for r in chunks.orderBy("user_id", "chunk").collect():
        assert r.items_actioned_on.count(",") < 4
        got.setdefault(r.user_id, []).append(r.items_actioned_on)
    wide = {r.user_id: r.items_actioned_on for r in tr.truth_wide(users, history, ("latest_timestamp",), 6).collect()}
    assert {u: ",".join(parts) for u, parts in got.items()} == wide
    assert tr.truth_chunks(users, history.limit(0), ("latest_timestamp",), k=6, chunk=4).count() == 8
    assert tr.truth_chunks(users.limit(0), history, ("latest_timestamp",), k=6).count() == 0


def test_truth_chunks_of_a_user_with_ten_million_actions(spark):
    from recoflow.operators import truth as tr

    history = spark.range(100_000).selectExpr("1 AS user_id", "concat('I', id % 50) AS item_id", "id AS latest_timestamp", "100 AS frequency")
    chunks = tr.truth_chunks(spark.range(1, 3).selectExpr("int(id) AS user_id"), history, ("latest_timestamp",))
    sizes = chunks.selectExpr("user_id", "size(split(items_actioned_on, ',')) AS n").groupBy("user_id").agg({"n": "sum"})
    assert {r[0]: r[1] for r in sizes.collect()} == {1: 10_000_000, 2: 72}
