"""The stored truth: bucketed tables that evaluations join without a shuffle."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from recoflow.functions.ranking import ideal_dcg
from recoflow.operators import evaluation as ev
from recoflow.operators.truth_store import Truth, TruthStore
from recoflow.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"
SCHEMA = "user_id int, item_id int, extra int"


@pytest.fixture(scope="module")
def inp(spark):
    return Inputs(spark, SF)


@pytest.fixture()
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges_above_truth(df):
    """For each scan of a stored truth: the exchanges between it and the join that reads it."""
    lines = [(len(m[1]), m[2]) for m in re.finditer(r"^([\s:|+-]*)(.*)$", df._jdf.queryExecution().executedPlan().toString(), re.M)]
    found = []
    for at, (depth, node) in enumerate(lines):
        if "recoflow_truth_" in node and "Scan" in node:
            path = []
            for d, above in reversed(lines[:at]):
                if d < depth:
                    depth = d
                    if "Join" in above:
                        break
                    path.append(above)
            found.append([n for n in path if "Exchange" in n])
    return found


def lists_of(inp):
    return ev.with_model(inp.segment_user_lists(inp.targets), "a").unionByName(ev.with_model(inp.own_top_lists(), "b"))


def test_evaluation_does_not_shuffle_the_truth(spark, inp, tmp_path, shuffled_joins):
    stored = TruthStore(spark, str(tmp_path)).save(inp.test_truth)
    lists = lists_of(inp)
    out = ev.evaluate(lists, stored, 72)
    scans = exchanges_above_truth(out)
    assert len(scans) >= 2 and not any(scans), scans
    scans = exchanges_above_truth(ev.relevance(lists, stored))
    assert len(scans) >= 2 and not any(scans), scans
    # the helper sees an exchange where there is one
    assert any(exchanges_above_truth(ev.evaluate(lists, stored.pairs, 72)))
    rounded = lambda t: sorted((r.model, r.n_lists, r.n_scored, round(r.mean_ndcg, 9), round(r.entropy, 9)) for r in t.collect())
    assert rounded(out) == rounded(ev.evaluate(lists, inp.test_truth, 72))
    for ideal in ("all", "truth"):
        own, given = (ev.ndcg_per_user(lists, t, 72, ideal).withColumn("ndcg", F.round("ndcg", 9)) for t in (stored, inp.test_truth))
        assert own.exceptAll(given).count() == 0 == given.exceptAll(own).count()


def test_another_session_finds_the_tables(spark, inp, tmp_path, shuffled_joins):
    place = str(tmp_path / "it's here")
    store = TruthStore(spark, place)
    assert not store.exists()
    stored = store.save(inp.test_truth)
    rows = stored.pairs.count()
    for t in spark.catalog.listTables():
        if t.name.startswith("recoflow_truth_"):
            spark.sql(f"DROP TABLE {t.name}")  # what a session that has not written them knows
    again = TruthStore(spark, place)
    assert again.exists() and again.load().pairs.count() == rows == inp.test_truth.count()
    assert not any(exchanges_above_truth(ev.relevance(lists_of(inp), again.load())))


def test_a_new_truth_leaves_readers_of_the_old_one(spark, tmp_path):
    store = TruthStore(spark, os.path.relpath(tmp_path))
    old = store.save(spark.createDataFrame([(1, 1, 0)], SCHEMA), buckets=3)
    new = store.save(spark.createDataFrame([(2, 5, 0), (2, 5, 1), (2, 6, 0)], SCHEMA), buckets=2)
    assert [tuple(r) for r in old.pairs.collect()] == [(1, 1)]
    assert sorted(tuple(r) for r in new.pairs.collect()) == [(2, 5), (2, 6)] and [r.user_id for r in new.users.collect()] == [2]


def test_nulls_empty_tables_and_a_hot_user(spark, tmp_path):
    lists = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (9, [1, 2])], "user_id int, items array<int>")
    truths = {
        "nulls": [(None, 1, 0), (1, None, 0), (2, 3, 0), (2, 3, 1)],
        "empty": [],
        "hot": [(1, i, 0) for i in range(20_000)] + [(2, 9, 0)],
    }
    for name, rows in truths.items():
        raw = spark.createDataFrame(rows, SCHEMA)
        stored = TruthStore(spark, str(tmp_path / name)).save(raw, buckets=8)
        score = lambda t: sorted((r.user_id, round(r.ndcg, 9)) for r in ev.ndcg_per_user(lists, t, 2).collect())
        assert score(stored) == score(raw), name
        assert sorted(map(tuple, ev.relevance(lists, stored, 2).collect())) == sorted(map(tuple, ev.relevance(lists, raw, 2).collect()))
        assert os.path.exists(tmp_path / name / "_CURRENT")
    # one user's many items lie in all buckets
    per_file = stored.pairs.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 8 and max(r["count"] for r in per_file) < 4_000


def test_lists_are_dealt_whole_for_ndcg(spark, inp, tmp_path, shuffled_joins):
    """No position of a list is shuffled: lists meet the truth as arrays, whichever way it is kept."""
    stored = TruthStore(spark, str(tmp_path)).save(inp.test_truth)
    lists = lists_of(inp)
    old = Truth(stored.pairs, stored.users)  # a store written before there were buckets by user
    scores = []
    for truth in (stored, old, inp.test_truth):
        per_user = ev.ndcg_per_user(lists, truth, 72)
        assert "posexplode" not in per_user._jdf.queryExecution().optimizedPlan().toString()
        scores.append(sorted((r.model, r.user_id, round(r.ndcg, 9)) for r in per_user.collect()))
    assert scores[0] == scores[1] == scores[2] and scores[0]


def test_gain_counts_repeats_up_to_k_and_skips_nulls(spark):
    lists = spark.createDataFrame(
        [(1, [7, None, 7, 8, 7]), (2, [None, None]), (3, [1]), (4, [1]), (None, [1])], "user_id int, items array<int>"
    )
    truth = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 5), (3, None), (None, 1)], "user_id int, item_id int")
    got = {r.user_id: r.ndcg for r in ev.ndcg_per_user(lists, truth, 4).collect()}
    assert set(got) == {1, 2, 3} and got[2] == got[3] == 0
    assert abs(got[1] * ideal_dcg(4) - (1 + 0.5 + 1 / math.log2(5))) < 1e-12
