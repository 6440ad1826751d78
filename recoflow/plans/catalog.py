"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's test tables through the fixture views and
runs over the whole tables. Floating outputs are rounded to 6 places so
they compare with the SQL oracle (``recoflow.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.config import DEFAULT_K, ITEM_PREFIX, SILHOUETTE_SWEEP
from recoflow.functions.lists import join_items
from recoflow.operators import als as als_ops
from recoflow.operators import clustering as cl
from recoflow.operators import evaluation as ev
from recoflow.operators import explore as ex
from recoflow.operators import features as feat
from recoflow.operators import folds
from recoflow.operators import history as hist
from recoflow.operators import popularity as pop
from recoflow.operators import topk
from recoflow.operators import truth as tr
from recoflow.operators.ledger import GridLedger
from recoflow.operators.merge import merge_lists
from recoflow.plans.compare import compare_hybrids
from recoflow.plans.inputs import Inputs
from recoflow.operators.split import temporal_split
from recoflow.plans import checks, file_queries
from recoflow.plans.recommender import HybridRecommender
from recoflow.session import ensure_checkpoint_dir
from recoflow.sources import tables
from recoflow.sources.files import join
from recoflow.sources.tables import HISTORY_ORDER

K = DEFAULT_K

# Model sizes of the registered MLlib queries: parameters of the queries, chosen so
# that a check takes seconds; the library's defaults are the full sizes (config.py).
ALS_PARAMS = {"rank": 10, "max_iter": 10, "reg_param": 0.1}
KMEANS_K = 20
SILHOUETTE_KS = (5, 10, 20, 40)
COMPARE = {"ks": (10, 20), "ranks": (5, 10), "max_iter": 5}
GRID = {"max_iters": (2, 5), "reg_params": (0.01, 0.1), "ranks": (5, 10)}
GRID_FOLDS = 3


def r6(col: str):
    return F.round(F.col(col), 6).alias(col)


# -- history -----------------------------------------------------------------

def history_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.clean_history(Inputs(spark, sf_dir).history)


def temporal_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    labelled = hist.label_slices(inp.history, inp.split)
    return hist.clean_history(labelled, keep=("o_orderkey", "l_linenumber", "l_suppkey", "slice"))


def temporal_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return hist.slice_summary(hist.label_slices(inp.history, inp.split))


def train_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).train_freqs


def train_test_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.item_frequencies(Inputs(spark, sf_dir).train_test_rows)


def target_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train frequencies of the target users that the data names: those active in the validation slice."""
    inp = Inputs(spark, sf_dir)
    return inp.train_freqs.join(inp.active_targets, "user_id", "left_semi")


def target_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the users active in the validation slice."""
    inp = Inputs(spark, sf_dir)
    return ex.restrict_users(inp.users, inp.active_targets)


def first_target_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment lists of the 100 smallest target ids (a top-n report)."""
    inp = Inputs(spark, sf_dir)
    return pop.as_list_strings(inp.segment_user_lists(ex.first_users(inp.targets, 100)))


def event_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 70 / 20 / rest split of the events, whose time has microseconds."""
    events = tables.events(spark, sf_dir)
    return temporal_split(events, ("ts", "event_id")).labelled(events).select("event_id", "user_id", "slice")


def event_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of the event times alone, with every time twice: cuts fall among equal rows."""
    once = tables.events(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    twice = once.unionByName(once)
    labelled = temporal_split(twice, ("hour",)).labelled(twice)
    return labelled.groupBy("slice", "event_type").agg(F.count(F.lit(1)).alias("n_rows"))


def random_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90 / 10 split and the four-way split: rows in all, rows lost, rows in two parts."""
    keys = Inputs(spark, sf_dir).kept_freqs().select("user_id", "item_id")
    parts = []
    for name, weights in (("two", (0.9, 0.1)), ("four", (0.1, 0.5, 0.2, 0.2))):
        split = folds.split_label(keys, weights).groupBy("user_id", "item_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi")
        )
        both = keys.join(split, ["user_id", "item_id"], "left")
        parts.append(both.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("n").isNull(), 1)).alias("n_lost"),
            F.count(F.when((F.col("lo") < F.col("hi")) | (F.col("lo") < 0) | (F.col("hi") >= len(weights)), 1)).alias("n_misplaced"),
        ).select(F.lit(name).alias("split"), "n_rows", "n_lost", "n_misplaced"))
    return parts[0].unionByName(parts[1])


def random_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every pair in the 90 / 10 and in the four-way split by exact hash ranks."""
    freqs = Inputs(spark, sf_dir).kept_freqs()
    two = folds.split_label(freqs, (0.9, 0.1), name="two", cols=("user_id", "item_id"))
    return folds.split_label(two, (0.1, 0.5, 0.2, 0.2), name="four", cols=("user_id", "item_id"))


def fold_training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and frequencies of the other folds (the training set) and of the fold itself, per fold."""
    data = folds.assign_folds(Inputs(spark, sf_dir).train_freqs, 10)

    def sums(df: DataFrame, i: int, part: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("frequency").alias("frequency")).select(
            F.lit(i).alias("fold"), F.lit(part).alias("part"), "n_pairs", "frequency"
        )

    parts = [sums(f(data, i), i, part) for i in range(10) for f, part in ((folds.fold_train, "train"), (folds.fold_test, "test"))]
    return reduce(DataFrame.unionByName, parts)


def full_own_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own top-10 lists of mixed length: the full ones only."""
    inp = Inputs(spark, sf_dir)
    top = pop.group_lists(pop.group_top_k(inp.train_freqs, "user_id", 10), "user_id")
    return pop.as_list_strings(ev.full_lists(top, 10))


# -- exploration / features ----------------------------------------------------

def feature_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.feature_value_counts(Inputs(spark, sf_dir).users)


def feature_value_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts with their rank within each feature."""
    return ex.ranked_value_counts(ex.feature_value_counts(Inputs(spark, sf_dir).users))


def distinct_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return ex.distinct_summary(inp.history, inp.users, inp.targets)


def feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = Inputs(spark, sf_dir).users
    model = feat.fit_features(users)
    labels = feat.indexer_labels(spark, model)
    counts = ex.feature_value_counts(users)
    return labels.join(counts, ["feature", "value"], "inner").select("feature", "value", "count", "index")


def feature_vector_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = Inputs(spark, sf_dir).users
    model = feat.fit_features(users)
    return feat.vector_slots(feat.make_features(users, model))


# -- popularity ------------------------------------------------------------------

def global_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pop.global_top_k(Inputs(spark, sf_dir).train_freqs, K)


def segment_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return pop.group_popularity(inp.train_freqs, inp.user_segments, "segment")


def segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).segment_top()


def segment_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return pop.as_list_strings(inp.segment_user_lists(inp.targets))


def user_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's own top-K train items (the primary list of the SQL-checkable merges)."""
    return pop.as_list_strings(Inputs(spark, sf_dir).own_top_lists())


# -- merges ------------------------------------------------------------------------

def _merged(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    users = inp.hybrid_users
    return merge_lists(users, inp.own_top_lists(), inp.segment_user_lists(users), inp.global_list(), K, mode)


def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pop.as_list_strings(_merged(spark, sf_dir, "hybrid"))


def hybrid_merge_self_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pop.as_list_strings(_merged(spark, sf_dir, "self_fill"))


def interleave_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pop.as_list_strings(_merged(spark, sf_dir, "interleave"))


def submission_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir, "hybrid")
    return merged.select("user_id", join_items("items", prefix=ITEM_PREFIX).alias("recommend_items"))


# -- truth and metrics --------------------------------------------------------------

def truth_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.truth_long(Inputs(spark, sf_dir).test_rows)


def truth_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return tr.truth_wide(inp.users, inp.test_rows, HISTORY_ORDER, K)


def truth_wide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide truth in numbered pieces, short ones so that lists take several."""
    inp = Inputs(spark, sf_dir)
    return tr.truth_chunks(inp.users, inp.test_rows, HISTORY_ORDER, K, chunk=16)


def _segment_eval_lists(inp: Inputs) -> DataFrame:
    return ev.full_lists(ev.with_model(inp.segment_user_lists(inp.targets), "segment"), K)


def relevance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return ev.relevance(_segment_eval_lists(inp), inp.test_truth, K).drop(ev.MODEL)


def _ndcg(inp: Inputs) -> DataFrame:
    return ev.ndcg_per_user(_segment_eval_lists(inp), inp.test_truth, K)


def ndcg_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ndcg(Inputs(spark, sf_dir)).select("user_id", r6("ndcg"))


def ndcg_ideal_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG@K with iDCG over min(K, |truth|) positions (the RankingEvaluator definition)."""
    inp = Inputs(spark, sf_dir)
    return ev.ndcg_per_user(_segment_eval_lists(inp), inp.test_truth, K, ideal="truth").select("user_id", r6("ndcg"))


def ndcg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.ndcg_summary(_ndcg(Inputs(spark, sf_dir)))
    return s.select("n_scored", r6("mean_ndcg"), r6("min_ndcg"), r6("max_ndcg"))


def ndcg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ev.ndcg_histogram(_ndcg(Inputs(spark, sf_dir)), bins=50)
    return h.select("bin", r6("lower"), r6("upper"), "n")


def item_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.item_exposure(_segment_eval_lists(Inputs(spark, sf_dir))).drop(ev.MODEL)


def entropy_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.entropy_at_k(_segment_eval_lists(Inputs(spark, sf_dir)), K)
    return e.select("n_users", "z", r6("entropy"))


def catalogue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    catalogue = hist.clean_history(inp.history).select("item_id")
    c = ev.catalogue_coverage(_segment_eval_lists(inp), catalogue)
    return c.select("n_items_recommended", "n_items_catalogue", r6("coverage"))


def evaluate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three list sets scored in one pass against the stored truth: segment lists and global lists of
    T, hybrid lists of T plus cold users."""
    inp = Inputs(spark, sf_dir)
    g = inp.global_list()
    segment = ev.with_model(inp.segment_user_lists(inp.targets), "segment")
    global_ = ev.with_model(merge_lists(inp.targets, None, None, g, K, "hybrid"), "global")
    users = inp.hybrid_users
    hybrid = ev.with_model(
        merge_lists(users, inp.own_top_lists(), inp.segment_user_lists(users), g, K, "hybrid"), "hybrid"
    )
    lists = segment.unionByName(global_).unionByName(hybrid)
    out = ev.evaluate(lists, inp.stored_truth(), K)
    return out.select(ev.MODEL, "n_lists", "n_scored", r6("mean_ndcg"), r6("entropy"), "n_items_recommended")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many merge users have a primary list / a truth, and how many not."""
    inp = Inputs(spark, sf_dir)
    users = inp.hybrid_users
    # Read off the per-pair tables (already aggregated, exchanges shared with the merge inputs).
    known = inp.train_freqs.select("user_id").distinct().withColumn("_p", F.lit(1))
    truthy = inp.test_truth.select("user_id").distinct().withColumn("_t", F.lit(1))
    flags = users.join(known, "user_id", "left").join(truthy, "user_id", "left")
    agg = flags.agg(
        F.count(F.lit(1)).alias("users"),
        F.count("_p").alias("with_primary"),
        F.count("_t").alias("with_truth"),
    )
    long = agg.select(
        F.col("users"),
        F.col("with_primary"),
        (F.col("users") - F.col("with_primary")).alias("without_primary"),
        F.col("with_truth"),
        (F.col("users") - F.col("with_truth")).alias("without_truth"),
    )
    return long.unpivot(ids=[], values=long.columns, variableColumnName="category", valueColumnName="n_users")


# -- MLlib-backed (rows-only checks) -------------------------------------------------

def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.assign_folds(Inputs(spark, sf_dir).train_freqs, 10)


def _als_model(inp: Inputs):
    return als_ops.fit_als(inp.kept_train, **ALS_PARAMS)


def als_recommend_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return pop.as_list_strings(als_ops.recommend_subset(_als_model(inp), inp.targets, K))


def als_recommend_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return pop.as_list_strings(als_ops.recommend_all(_als_model(inp), K))


def als_pruned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-K over all items by pruned inner-product search, as the list strings of ``als_recommend_all``."""
    return pop.as_list_strings(topk.pruned_recommendations(_als_model(Inputs(spark, sf_dir)), k=K).select("user_id", "items"))


def als_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    train, test = inp.kept_slice_freqs()
    value = als_ops.rmse(als_ops.fit_als(train, **ALS_PARAMS), test)
    return spark.createDataFrame(
        [(ALS_PARAMS["max_iter"], ALS_PARAMS["reg_param"], ALS_PARAMS["rank"], value)],
        "maxIter int, regParam double, rank int, rmse double",
    )


def _grid(spark: SparkSession, sf_dir: str) -> GridLedger:
    data = folds.assign_folds(Inputs(spark, sf_dir).kept_freqs(), GRID_FOLDS)
    path = join(ensure_checkpoint_dir(spark), "grids")
    return GridLedger(spark, path, data, "fold", GRID_FOLDS, keep_factors=True)


def als_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated RMSE of every setting, best first; (setting, fold) fits that the ledger holds are not repeated."""
    return _grid(spark, sf_dir).search(**GRID)


def _clusters(inp: Inputs):
    users = cl.dealt(inp.users)
    fmodel = feat.fit_features(inp.users)
    features = feat.make_features(users, fmodel)
    model = cl.fit_kmeans(features, KMEANS_K)
    return features, model


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, model = _clusters(Inputs(spark, sf_dir))
    return cl.assign_clusters(features, model)


def kmeans_silhouette_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    features = feat.make_features(cl.dealt(inp.users), feat.fit_features(inp.users))
    return cl.silhouette_sweep(spark, features, SILHOUETTE_KS)


def kmeans_profile_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes over weighted profiles for all sizes of the full sweep."""
    users = Inputs(spark, sf_dir).users
    return cl.profile_sweep(spark, users, feat.fit_features(users), SILHOUETTE_SWEEP, parallelism=8)


def cluster_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    features, model = _clusters(inp)
    clusters = cl.assign_clusters(features, model)
    lists = cl.cluster_lists(inp.train_freqs, clusters, K)
    return pop.as_list_strings(cl.cluster_recommendations(inp.targets, clusters, lists, KMEANS_K))


def hybrid_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: ALS lists, KMeans-cluster lists and global popularity merged
    for T plus cold users."""
    inp = Inputs(spark, sf_dir)
    rec = HybridRecommender(k_clusters=KMEANS_K, **ALS_PARAMS, top_k=K).fit(inp.train_freqs, inp.users)
    return rec.recommend(inp.hybrid_users)


def hybrid_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters k x ALS rank grid scored by nDCG@K / Entropy@K on the test slice."""
    inp = Inputs(spark, sf_dir)
    out = compare_hybrids(
        inp.train_freqs, inp.users, inp.targets, inp.test_truth, COMPARE["ks"], COMPARE["ranks"],
        max_iter=COMPARE["max_iter"], reg_param=ALS_PARAMS["reg_param"], top_k=K,
    )
    return out.select("k", "rank", "n_lists", "n_scored", r6("mean_ndcg"), r6("entropy"), "n_items_recommended")


# -- model-backed operators by properties that SQL can state ---------------------------

def als_subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALS lists of the target users: users, and violations of what every list must be."""
    inp = Inputs(spark, sf_dir)
    model = _als_model(inp)
    return checks.als_lists(model, als_ops.recommendations_with_scores(model, inp.active_targets, K, long=False), inp.kept_train, K)


def als_all_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALS lists of all users of the model: users, and violations."""
    inp = Inputs(spark, sf_dir)
    model = _als_model(inp)
    return checks.als_lists(model, als_ops.all_recommendations_with_scores(model, K, long=False), inp.kept_train, K)


def als_pruned_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned lists of all users of the model: what every list must be, and position by position against the lists of all scored pairs."""
    inp = Inputs(spark, sf_dir)
    model = _als_model(inp)
    own = topk.pruned_recommendations(model, k=K)
    same = checks.same_lists(own, als_ops.all_recommendations_with_scores(model, K, prune=False, long=False)).select("n_wrong_position")
    return checks.als_lists(model, own, inp.kept_train, K).withColumn("n_wrong_position", same.scalar())


def als_rmse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE against its definition on the factors: scored pairs, and whether both agree."""
    train, test = Inputs(spark, sf_dir).kept_slice_freqs()
    return checks.als_rmse(als_ops.fit_als(train, **ALS_PARAMS), test)


def als_grid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid against a recount of every (setting, fold) from the written factors."""
    ledger = _grid(spark, sf_dir)
    result = ledger.search(**GRID)
    return checks.grid(result, ledger.scores(**GRID), ledger.recount(**GRID))


def kmeans_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user assigned once, to the nearest centre."""
    inp = Inputs(spark, sf_dir)
    features, model = _clusters(inp)
    return checks.kmeans(features, model, cl.assign_clusters(features, model))


def silhouette_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score over weighted profiles against MLlib's evaluator on all users, without weights."""
    users = Inputs(spark, sf_dir).users
    sweep = cl.profile_sweep(spark, users, feat.fit_features(users), SILHOUETTE_SWEEP, parallelism=8, recount=True)
    return checks.silhouettes(sweep, len(SILHOUETTE_SWEEP))


def cluster_lists_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster lists of the targets against a recount over the assigned clusters."""
    inp = Inputs(spark, sf_dir)
    features, model = _clusters(inp)
    clusters = cl.assign_clusters(features, model)
    lists = cl.cluster_recommendations(inp.targets, clusters, cl.cluster_lists(inp.train_freqs, clusters, K), KMEANS_K)
    return checks.cluster_lists(lists, clusters, inp.train_freqs, K)


def hybrid_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's lists: all users, K distinct items, known users' lists start with the ALS list."""
    inp = Inputs(spark, sf_dir)
    rec = HybridRecommender(k_clusters=KMEANS_K, **ALS_PARAMS, top_k=K).fit(inp.train_freqs, inp.users)
    return checks.hybrid_lists(rec.recommend_arrays(inp.hybrid_users), rec.als_user_lists(inp.hybrid_users), K)


def comparison_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations compared on the same targets: lists, scored users, violations."""
    return checks.comparison(hybrid_comparison(spark, sf_dir), K)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "history_clean": history_clean,
    "temporal_split_counts": temporal_split_counts,
    "temporal_split_rows": temporal_split_rows,
    "train_frequencies": train_frequencies,
    "train_test_frequencies": train_test_frequencies,
    "target_frequencies": target_frequencies,
    "feature_value_counts": feature_value_counts,
    "distinct_summary": distinct_summary,
    "feature_index": feature_index,
    "feature_vector_slots": feature_vector_slots,
    "global_top_k": global_top_k,
    "segment_popularity": segment_popularity,
    "segment_top_k": segment_top_k,
    "segment_recommendations": segment_recommendations,
    "user_top_k": user_top_k,
    "hybrid_merge": hybrid_merge,
    "hybrid_merge_self_fill": hybrid_merge_self_fill,
    "interleave_merge": interleave_merge,
    "submission_format": submission_format,
    "truth_long": truth_long,
    "truth_wide": truth_wide,
    "truth_wide_chunks": truth_wide_chunks,
    "relevance_flags": relevance_flags,
    "ndcg_per_user": ndcg_per_user,
    "ndcg_ideal_truth": ndcg_ideal_truth,
    "ndcg_summary": ndcg_summary,
    "ndcg_histogram": ndcg_histogram,
    "item_exposure": item_exposure,
    "entropy_at_k": entropy_at_k,
    "catalogue_coverage": catalogue_coverage,
    "evaluate_models": evaluate_models,
    "coverage_report": coverage_report,
    "fold_assignment": fold_assignment,
    "als_recommend_subset": als_recommend_subset,
    "als_recommend_all": als_recommend_all,
    "als_rmse": als_rmse,
    "als_grid_search": als_grid_search,
    "kmeans_assign": kmeans_assign,
    "kmeans_silhouette_sweep": kmeans_silhouette_sweep,
    "kmeans_profile_sweep": kmeans_profile_sweep,
    "cluster_recommendations": cluster_recommendations,
    "hybrid_recommend": hybrid_recommend,
    "hybrid_comparison": hybrid_comparison,
    "target_features": target_features,
    "first_target_lists": first_target_lists,
    "event_split_rows": event_split_rows,
    "event_split_counts": event_split_counts,
    "random_split_counts": random_split_counts,
    "random_split_rows": random_split_rows,
    "fold_training_sets": fold_training_sets,
    "full_own_lists": full_own_lists,
    "feature_value_ranks": feature_value_ranks,
    "als_subset_check": als_subset_check,
    "als_all_check": als_all_check,
    "als_rmse_check": als_rmse_check,
    "als_pruned_lists": als_pruned_lists,
    "als_pruned_check": als_pruned_check,
    "als_grid_check": als_grid_check,
    "kmeans_check": kmeans_check,
    "silhouette_check": silhouette_check,
    "cluster_lists_check": cluster_lists_check,
    "hybrid_check": hybrid_check,
    "comparison_check": comparison_check,
    **file_queries.QUERIES,
}

__all__ = ["QUERIES"]
