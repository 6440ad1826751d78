"""Command-line runs of the pipeline over TSV inputs (the reference's file layout).

    python -m recoflow.plans.cli prepare   --data DIR --out DIR
    python -m recoflow.plans.cli recommend --data DIR --out DIR [--k-clusters N --rank N ...]
    python -m recoflow.plans.cli evaluate  --out DIR --lists NAME=PATH [NAME=PATH ...]
    python -m recoflow.plans.cli grid      --out DIR [--folds N]
    python -m recoflow.plans.cli silhouette --data DIR --ks 5,10,20

``DIR`` holds ``item_history.tsv``, ``user_master.tsv`` and ``target_users.tsv``
(headers; item ids prefixed with "I"). ``prepare`` writes the train / test
frequencies (Parquet), the split thresholds and the padded truth files;
``recommend`` publishes the model, the lists (``user_id \\t id,id,...``) and the
submission as versions (see ``recoflow.sinks.publish``); ``evaluate`` prints one row per list file. The session comes
from ``SparkSession.builder.getOrCreate()`` so cluster settings apply.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from recoflow.config import ALS_FOLDS, DEFAULT_K, HYBRID_DEFAULTS, SILHOUETTE_SWEEP
from recoflow.operators import clustering as cl
from recoflow.operators import evaluation as ev
from recoflow.operators import features as feat
from recoflow.operators import folds
from recoflow.operators import history as hist
from recoflow.operators import truth as tr
from recoflow.operators.ledger import GridLedger
from recoflow.operators.split import TemporalSplit, temporal_split
from recoflow.operators.split_index import load_split, save_split
from recoflow.operators.truth_store import TruthStore
from recoflow.plans.recommender import HybridRecommender
from recoflow.sinks import writers
from recoflow.sinks.publish import current, publish
from recoflow.sources import tsv
from recoflow.sources.files import join, path_exists

ORDER = ("latest_timestamp", "user_id", "item_id", "frequency")


def _read(reader, spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table's rows with all required fields; the others are reported."""
    good, bad = tsv.accepted(reader(spark, path), table)
    if bad:
        print(f"{table}: {bad} rows with unparsable fields")
    return good


def _inputs(spark: SparkSession, data: str):
    history = _read(tsv.read_item_history, spark, join(data, "item_history.tsv"), "item_history")
    users = _read(tsv.read_user_master, spark, join(data, "user_master.tsv"), "user_master")
    targets = _read(tsv.read_target_users, spark, join(data, "target_users.tsv"), "target_users")
    return history, users, targets


def prepare(spark: SparkSession, data: str, out: str, k: int = DEFAULT_K, wide_truth: bool = True) -> TemporalSplit:
    """Split the history, write train / test frequencies and, with ``wide_truth``,
    the padded truth files (one row per user holds that user's whole slice)."""
    history, users, _ = _inputs(spark, data)
    history = hist.clean_history(history)
    split = temporal_split(history, ORDER)
    save_split(spark, split, join(out, "split"))
    train, test = split.train(history), split.test(history)
    writers.write_table(hist.item_frequencies(train), join(out, "train_frequencies"))
    writers.write_table(hist.item_frequencies(test), join(out, "test_frequencies"))
    TruthStore(spark, join(out, "test_truth")).save(spark.read.parquet(join(out, "test_frequencies")))
    if wide_truth:
        writers.write_truth(tr.truth_wide(users, train, ORDER, k), join(out, "y_train"))
        writers.write_truth(tr.truth_wide(users, test, ORDER, k), join(out, "y_test"))
    return split


def recommend(spark: SparkSession, data: str, out: str, k_clusters: int, rank: int, max_iter: int,
              reg_param: float, k: int = DEFAULT_K, mode: str = "hybrid", single_file: bool = False,
              reuse: bool = False) -> DataFrame:
    """Fit the hybrid on the prepared train frequencies (or, with ``reuse``, load
    the complete model saved there by an earlier call) and write lists + submission."""
    _, users, targets = _inputs(spark, data)
    freqs = spark.read.parquet(join(out, "train_frequencies"))
    path = writers.model_dir(join(out, "models"), "hybrid", k=k_clusters, rank=rank, maxIter=max_iter, regParam=reg_param)
    if reuse and path_exists(spark, join(current(spark, path), "settings/_SUCCESS")):
        rec = HybridRecommender.load(spark, current(spark, path), top_k=k, mode=mode)
    else:
        rec = HybridRecommender(k_clusters=k_clusters, rank=rank, max_iter=max_iter, reg_param=reg_param, top_k=k, mode=mode)
        publish(spark, path, rec.fit(freqs, users).save)
    lists = rec.recommend_arrays(targets)
    publish(spark, join(out, "lists_hybrid"), lambda p: writers.write_lists(lists, p))
    publish(spark, join(out, "submission"), lambda p: writers.write_submission(lists, p, single_file=single_file))
    rec.close()
    return lists


def evaluate(spark: SparkSession, out: str, lists: dict[str, str], k: int = DEFAULT_K,
             truth_path: str | None = None, validation_of: str | None = None) -> DataFrame:
    """Score list or submission files against the prepared test slice, against a
    wide truth file (``user_id \\t id,id,...``) when ``truth_path`` is given, or
    against the validation slice of the history under ``validation_of``, read off
    the saved split."""
    if truth_path:
        truth = tsv.read_truth_items(spark, truth_path)
    elif validation_of:
        history = hist.clean_history(_inputs(spark, validation_of)[0])
        truth = tr.truth_items(load_split(spark, join(out, "split")).validation(history))
    else:
        truth = TruthStore(spark, join(out, "test_truth")).load()
    return ev.evaluate_list_files(spark, {name: current(spark, path) for name, path in lists.items()}, truth, k)


def grid(spark: SparkSession, out: str, num_folds: int = ALS_FOLDS) -> DataFrame:
    from recoflow.config import ALS_GRID

    freqs = folds.assign_folds(spark.read.parquet(join(out, "train_frequencies")), num_folds)
    ledger = GridLedger(spark, join(out, "grid"), freqs, "fold", num_folds)  # a restart goes on where the last run ended
    return ledger.search(ALS_GRID["maxIter"], ALS_GRID["regParam"], ALS_GRID["rank"])


def silhouette(spark: SparkSession, data: str, ks: list[int]) -> DataFrame:
    _, users, _ = _inputs(spark, data)
    return cl.profile_sweep(spark, users, feat.fit_features(users), ks)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="recoflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--no-wide-truth", action="store_true", help="leave out the padded truth files")
    r = sub.add_parser("recommend")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--k-clusters", type=int, default=HYBRID_DEFAULTS["k"])
    r.add_argument("--rank", type=int, default=HYBRID_DEFAULTS["rank"])
    r.add_argument("--max-iter", type=int, default=HYBRID_DEFAULTS["max_iter"])
    r.add_argument("--reg-param", type=float, default=HYBRID_DEFAULTS["reg_param"])
    r.add_argument("--mode", default="hybrid", choices=["hybrid", "self_fill", "interleave"])
    r.add_argument("--single-file", action="store_true", help="write the submission as one file")
    r.add_argument("--reuse", action="store_true", help="load the model saved for these settings if it is complete")
    e = sub.add_parser("evaluate")
    e.add_argument("--out", required=True)
    e.add_argument("--lists", nargs="+", required=True, help="NAME=PATH")
    e.add_argument("--truth", default=None, help="wide truth file (y_test); default: the prepared test slice")
    e.add_argument("--validation-of", default=None, help="data folder whose validation slice is the truth")
    g = sub.add_parser("grid")
    g.add_argument("--out", required=True)
    g.add_argument("--folds", type=int, default=ALS_FOLDS)
    s = sub.add_parser("silhouette")
    s.add_argument("--data", required=True)
    s.add_argument("--ks", default=",".join(map(str, SILHOUETTE_SWEEP)))
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"recoflow-{args.cmd}").getOrCreate()
    if args.cmd == "prepare":
        split = prepare(spark, args.data, args.out, wide_truth=not args.no_wide_truth)
        print(json.dumps({"n": split.n, "train": split.n_train, "test": split.n_test}))
    elif args.cmd == "recommend":
        recommend(spark, args.data, args.out, args.k_clusters, args.rank, args.max_iter, args.reg_param,
                  mode=args.mode, single_file=args.single_file, reuse=args.reuse)
    elif args.cmd == "evaluate":
        pairs = dict(item.split("=", 1) for item in args.lists)
        evaluate(spark, args.out, pairs, truth_path=args.truth, validation_of=args.validation_of).show(truncate=False)
    elif args.cmd == "grid":
        grid(spark, args.out, args.folds).show(truncate=False)
    elif args.cmd == "silhouette":
        silhouette(spark, args.data, [int(x) for x in args.ks.split(",")]).show()


if __name__ == "__main__":
    main()
