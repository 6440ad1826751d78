"""The maintained split index: only new files are counted, changed files give a fresh split."""

import os
import shutil

import pyarrow.parquet as pq

from recoflow.operators.split import temporal_split
from recoflow.operators.split_index import CountIndex, SplitStore
from recoflow.plans.inputs import Inputs

ORDER = ("t", "v")


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "t bigint, v bigint").coalesce(1).write.mode(mode).parquet(path)


def test_index_counts_new_files_only_and_splits_like_a_scan(spark, tmp_path):
    data, index = f"{tmp_path}/a b%20c", CountIndex(spark, f"{tmp_path}/index", "t")
    write(spark, data, [(k % 7, k) for k in range(100)])
    write(spark, data, [(None, k) for k in range(5)])
    history = lambda: spark.read.parquet(data)
    assert len(index.update(history())) == 2 and index.update(history()) == []
    for rows in ([(k % 11, -k) for k in range(400)], [(3, 3)] * 50, [(10**9, 0)]):
        write(spark, data, rows)
        df = history()
        assert len(index.update(df)) == 1
        assert index.split(df, ORDER) == temporal_split(df, ORDER)
        assert {(r.t, r._n) for r in index.counts(df).collect()} == {(r.t, r["count"]) for r in df.groupBy("t").count().collect()}


def test_index_forgets_files_that_go_or_change(spark, tmp_path):
    data, index = f"{tmp_path}/h", CountIndex(spark, f"{tmp_path}/index", "t")
    for k in range(3):
        write(spark, data, [(k, i) for i in range(20 + k)])
    index.update(spark.read.parquet(data))
    write(spark, data, [(9, i) for i in range(30)], mode="overwrite")
    df = spark.read.parquet(data)
    assert len(index.update(df)) == 1
    assert [tuple(r) for r in index.counts(df).collect()] == [(9, 30)]
    assert index.split(df, ORDER) == temporal_split(df, ORDER)


def test_index_of_an_empty_history(spark, tmp_path):
    data, index = f"{tmp_path}/h", CountIndex(spark, f"{tmp_path}/index", "t")
    write(spark, data, [])
    df = spark.read.parquet(data)
    index.update(df)
    assert index.counts(df).collect() == [] and index.update(df) == []
    assert index.split(df, ORDER).n == 0


def test_store_finds_once_per_state(spark, tmp_path):
    data, store = f"{tmp_path}/h", SplitStore(spark, f"{tmp_path}/splits")
    found = []

    def split():
        df = spark.read.parquet(data)

        def find():
            found.append(1)
            return temporal_split(df, ORDER)

        return store.get([df], ORDER, find)

    write(spark, data, [(k % 5, k) for k in range(50)])
    first = split()
    assert split() == first and len(found) == 1
    write(spark, data, [(k % 5, -k) for k in range(70)])
    assert split() == temporal_split(spark.read.parquet(data), ORDER) != first and len(found) == 2


def test_inputs_see_new_data(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("lineitem", "orders"):
        shutil.copy(os.path.join(sf, f"{name}.parquet"), f"{tmp_path}/{name}.parquet")
    one = Inputs(spark, str(tmp_path)).split
    assert Inputs(spark, str(tmp_path)).split == one == Inputs(spark, sf).split
    rows = pq.read_table(f"{sf}/lineitem.parquet")
    fewer = rows.slice(0, len(rows) // 2)
    os.chmod(f"{tmp_path}/lineitem.parquet", 0o644)
    pq.write_table(fewer, f"{tmp_path}/lineitem.parquet")
    two = Inputs(spark, str(tmp_path)).split
    assert two.n == len(fewer) != one.n
    assert Inputs(spark, str(tmp_path)).train_rows.count() == two.n_train == int(two.n * 0.7)
