"""The sanity values FIXTURES.md publishes for segment lists (targets with
user_id % 4 = 0, K = 72, train slice scored on the test slice), reproduced
end to end: split, frequencies, segment top-K lists, nDCG@72, Entropy@72."""

import pytest
from pyspark.sql import functions as F

from recoflow.operators import evaluation as ev
from recoflow.plans.inputs import Inputs

# Fixed values from FIXTURES.md §3: lists, users scored, mean nDCG, max nDCG, entropy, items.
EXPECTED = {
    "/root/testdata/sf0.001": (38, 34, 0.046187, 0.158509, 7.313696, 176),
    "/root/testdata/sf0.01": (375, 317, 0.004894, 0.060269, 8.307981, 329),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_segment_list_metrics_match_published_values(spark, sf):
    inp = Inputs(spark, sf)
    targets = inp.targets.where(F.col("user_id") % 4 == 0)  # the published target set
    lists = ev.full_lists(ev.with_model(inp.segment_user_lists(targets), "segment"))
    summary = ev.ndcg_summary(ev.ndcg_per_user(lists, inp.test_truth)).first()
    entropy = ev.entropy_at_k(lists).first()
    items = ev.item_exposure(lists).count()
    n_lists, n_scored, mean, mx, ent, n_items = EXPECTED[sf]
    assert entropy.n_users == n_lists and summary.n_scored == n_scored and items == n_items
    assert round(summary.mean_ndcg, 6) == mean and round(summary.max_ndcg, 6) == mx
    assert round(entropy.entropy, 6) == ent


# Fixed values from FIXTURES.md §3 (sf0.001, sf0.01).
FACTS = {
    "/root/testdata/sf0.001": {"profiles": 145, "rows_at_cut": 6, "cold": 0, "empty_test": 18, "max_test_freq": 975, "item0_rows": 37},
    "/root/testdata/sf0.01": {"profiles": 1294, "rows_at_cut": 21, "cold": 6, "empty_test": 228, "max_test_freq": 968, "item0_rows": 34},
}
SILHOUETTES = {5: 0.1615, 20: 0.0785, 60: 0.0897, 120: 0.1166, 145: 0.0667}  # sf0.001, KMeans seed 42


@pytest.mark.parametrize("sf", sorted(FACTS))
def test_published_properties_of_the_views(spark, sf):
    from recoflow.sources.tables import FEATURE_COLS

    inp = Inputs(spark, sf)
    u, h, s = inp.users, inp.history, inp.split
    got = {
        "profiles": u.select(*FEATURE_COLS).distinct().count(),
        "rows_at_cut": h.where(F.col("latest_timestamp") == s.train_cut.values[0]).count(),
        "cold": inp.cold_users.count(),
        "empty_test": u.select("user_id").join(inp.test_truth.select("user_id").distinct(), "user_id", "left_anti").count(),
        "max_test_freq": inp.test_rows.groupBy("user_id").agg(F.sum("frequency").alias("f")).agg(F.max("f")).first()[0],
        "item0_rows": h.where(F.col("l_partkey") == 0).count(),
    }
    assert got == FACTS[sf]


def test_pairs_repeat_in_the_history(spark):
    from recoflow.sources.tables import item_history

    h = item_history(spark, "/root/testdata/sf0.01")
    assert (h.count(), h.select("user_id", "item_id").distinct().count()) == (60000, 59391)


def test_published_silhouettes(spark):
    from recoflow.operators import clustering as cl
    from recoflow.operators import features as feat

    users = Inputs(spark, "/root/testdata/sf0.001").users
    vectors = feat.make_features(users, feat.fit_features(users))
    got = {r.clusters: round(r.silhouette, 4) for r in cl.silhouette_sweep(spark, vectors, sorted(SILHOUETTES)).collect()}
    assert got == SILHOUETTES
