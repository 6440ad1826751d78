"""The temporal split off the beaten path: copies, nulls, sub-seconds, key types."""

import datetime
import random
from collections import Counter

import pytest

from recoflow.operators import history as hist
from recoflow.operators.split import slice_sizes, temporal_split
from recoflow.plans import catalog
from recoflow.plans.inputs import Inputs
from recoflow.sources import tables


def slices(df, cols):
    s = temporal_split(df, cols)
    parts = [s.train(df), s.test(df), s.validation(df)]
    labelled = s.labelled(df).collect()
    for part, name in zip(parts, ("train", "test", "validation")):
        own = Counter(tuple(r)[:-1] for r in labelled if r["slice"] == name)
        assert Counter(map(tuple, part.collect())) == own
    both = Counter(map(tuple, s.train_test(df).collect()))
    assert both == Counter(map(tuple, parts[0].collect())) + Counter(map(tuple, parts[1].collect()))
    return [sorted(map(tuple, p.collect()), key=repr) for p in parts]


def check(spark, rows, schema, cols):
    """Sizes and contents against a sort (nulls first, ties by the other columns)."""
    df = spark.createDataFrame(rows, schema).repartition(4)
    names = df.columns
    order = [names.index(c) for c in [*cols, *[c for c in names if c not in cols]]]
    ranked = sorted(rows, key=lambda r: [(r[i] is not None, r[i]) if r[i] is not None else (False, 0) for i in order])
    a, b = slice_sizes(len(rows))
    want = [ranked[:a], ranked[a : a + b], ranked[a + b :]]
    assert slices(df, cols) == [sorted(w, key=repr) for w in want]


def test_equal_rows_on_the_cut(spark):
    check(spark, [(5, "x")] * 10, "t bigint, v string", ("t",))
    check(spark, [(5, "x")] * 7 + [(5, "y")] * 3 + [(4, "x")] * 5 + [(9, "z")] * 2, "t bigint, v string", ("t",))


def test_null_keys_sort_first(spark):
    check(spark, [(None, 1), (None, 2), (None, 3)] + [(k, k) for k in range(7)], "t bigint, v int", ("t",))
    check(spark, [(None, 1)] * 9 + [(1, None)], "t bigint, v int", ("t",))
    check(spark, [(k % 2, None if k % 3 else k) for k in range(20)], "t bigint, v int", ("t", "v"))


def test_string_and_timestamp_keys(spark):
    rnd = random.Random(4)
    check(spark, [(f"k{rnd.randint(0, 40)}", k) for k in range(200)], "t string, v int", ("t",))
    times = [datetime.datetime(2024, 3, 1, 0, 0, rnd.randint(0, 3), rnd.randint(0, 999_999)) for _ in range(200)]
    for kind in ("timestamp", "timestamp_ntz"):
        check(spark, [(t, k % 7) for k, t in enumerate(times)], f"t {kind}, v int", ("t", "v"))


def test_many_distinct_values_take_the_same_way(spark):
    """More distinct values than the earlier collect limit, as strings."""
    df = spark.range(150_000).selectExpr("sha1(string(id)) AS t", "id AS v")
    s = temporal_split(df, ("t",))
    assert (s.train(df).count(), s.test(df).count(), s.validation(df).count()) == (105_000, 30_000, 15_000)
    assert s.train(df).selectExpr("max(t)").first()[0] < s.test(df).selectExpr("min(t)").first()[0]


def test_a_third_of_all_rows_are_one_row(spark):
    rows = [(50, 1)] * 300 + [(k, k) for k in range(100)] + [(50 + k % 3, k) for k in range(500)]
    check(spark, rows, "t bigint, v int", ("t",))


@pytest.mark.parametrize("upper,kept", [(True, [True, True, False]), (False, [True, True, True])])
def test_time_bound_keeps_sub_seconds(spark, upper, kept):
    """Instants after the second t, up to t + 1 s, belong to second t."""
    at = datetime.datetime(2024, 1, 1, 0, 0, 10)
    rows = [(k, at + datetime.timedelta(milliseconds=m)) for k, m in enumerate((0, 500, 1000))]
    df = spark.createDataFrame(rows, "k int, o_orderdate timestamp_ntz")
    second = int(at.replace(tzinfo=datetime.timezone.utc).timestamp())
    got = {r.k for r in df.where(tables.time_bound(second, upper)).collect()}
    assert [k in got for k in range(3)] == kept


def test_rows_of_all_cut_values_are_asked_for_once(spark):
    from recoflow.operators.split import locate_ranks

    rows = [(t, i, None if i % 5 == 0 else i % 3) for t in (1, 2, 3) for i in range(10)]
    df = spark.createDataFrame(rows, "t int, a int, b int")
    asked = []

    def rows_at(condition, n):
        asked.append(n)
        return df.where(condition)

    plain = locate_ranks(df, ("t", "a"), [4, 6, 27], 30)
    assert locate_ranks(df, ("t", "a"), [4, 6, 27], 30, rows_at=rows_at) == plain
    assert asked == [20] and [df.where(c.le()).count() for c in plain] == [4, 6, 27]


def test_cut_rows_are_found_without_shuffling_line_items(spark):
    from pyspark.sql import functions as F

    from recoflow.plans import catalog
    from recoflow.plans.inputs import Inputs

    sf = "/root/testdata/sf0.001"
    inp = Inputs(spark, sf)
    value = inp.history.agg(F.max("latest_timestamp")).first()[0]
    found = inp._rows_at(F.col("latest_timestamp") == value, 1)
    assert found.exceptAll(inp.history.where(F.col("latest_timestamp") == value)).count() == 0
    assert found.count() == inp.history.where(F.col("latest_timestamp") == value).count() > 0
    assert "rightHint" in (text := found._jdf.queryExecution().toString()) or "broadcast" in text.lower()
    # The parts of a random split are taken from frequencies that are found once.
    assert "orders.parquet" not in catalog.random_split_rows(spark, sf)._jdf.queryExecution().toString()


def test_rmse_reads_the_history_once(spark, monkeypatch):
    """Train and test frequencies come from one pass, and are those of the two slices."""
    inp = Inputs(spark, "/root/testdata/sf0.001")
    for kept, rows in zip(inp.kept_slice_freqs(), (inp.train_rows, inp.test_rows)):
        want = hist.item_frequencies(rows)
        assert kept.schema == want.schema and sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    calls, found = [], hist.item_frequencies
    monkeypatch.setattr(hist, "item_frequencies", lambda *a, **kw: calls.append(a) or found(*a, **kw))
    assert catalog.als_rmse_check(spark, inp.sf_dir).first()["n_wrong_rmse"] == 0
    assert catalog.als_rmse(spark, inp.sf_dir).first()["rmse"] > 0
    assert len(calls) == 2
