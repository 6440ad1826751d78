"""Session helpers.

Library code never hard-codes cluster settings: it reads what the session
was started with. ``local_session`` is for tests and the local bench only.
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "recoflow", extra: dict | None = None
) -> SparkSession:
    """A local session with AQE on and the UI off (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECOFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def use_cluster_checkpoint_dir(spark: SparkSession) -> str | None:
    """Library side: adopt the shared folder the cluster names in
    ``spark.checkpoint.dir``; never invent one (no machine-local folders).
    Without a JVM SparkContext (Spark Connect) the server's setting applies."""
    path = spark.conf.get("spark.checkpoint.dir", None) or None
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context to configure
        return path
    if path is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path or sc.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only a local master
    (tests, bench) may go without: it gets a fresh scratch folder."""
    path = use_cluster_checkpoint_dir(spark)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="recoflow-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Seconds between two collections at least, however many jobs ask for one; when the last one ended.
RELEASE_EVERY, _released, _releasing = 10.0, [float("-inf")], threading.Lock()


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the shuffle files and blocks that nothing refers to any more. It learns of them
    when the driver collects its garbage, which a driver with room to spare may not do for hours."""
    with _releasing:
        if time.monotonic() - _released[0] < RELEASE_EVERY:
            return
        _collect(spark)
        _released[0] = time.monotonic()


def _collect(spark: SparkSession) -> None:
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # Spark Connect: the server's driver is not ours
        pass


@contextmanager
def swept(spark: SparkSession, seconds: float = 15.0) -> Iterator[None]:
    """``release`` again and again while a long iterative job runs, and once at its end."""
    over = threading.Event()

    def sweep() -> None:
        while not over.wait(seconds):
            release(spark)

    thread = threading.Thread(target=sweep, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        release(spark)
