"""Session defaults. Everything here can be overridden by the cluster's own settings."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barflow", cpus: int | None = None) -> SparkSession:
    """A session for tests and local runs; on a cluster pass your own session to the library."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="barflow-"), "barflow"), "zip", root, "barflow")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a folder of our own only where none is named, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """Write a small intermediate table to the checkpoint folder and go on from there.

    Used where several branches read one result: neither the plan nor the work is repeated, and the files
    survive the loss of executors.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    """Partitions of tables that stay where their series are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Inside, tables that are `placed` and cut keep their partitions, so joins, windows and groups whose keys hold the series
    meet where the rows are. Adaptive execution would forget the partitions, and joins would ask for all of their keys."""
    own = {
        "spark.sql.shuffle.partitions": str(parts(spark)), "spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def placed(df: DataFrame) -> DataFrame:
    """Every series in the partition of its name; no shuffle where the rows are there already."""
    return df.repartition(parts(df.sparkSession), "symbol")


def cut_in_place(df: DataFrame) -> DataFrame:
    """Write a table of series that several steps read, every series in its place."""
    with in_place(df.sparkSession):
        return cut(placed(df))


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, in whatever store it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Inside, tables that are cut go to a folder of their own, which is removed at the end, and shuffle files go with the step that
    wrote them. Nothing that was cut inside can be read afterwards."""
    sc, clean = spark.sparkContext, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = sc.getCheckpointDir()
    base = own.rsplit("/", 1)[0] if own else checkpoint_dir(spark)  # Spark adds a name of its own
    folder, before = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}", spark.conf.get(clean)
    try:
        sc.setCheckpointDir(folder)
        spark.conf.set(clean, "true")
        yield
    finally:
        spark.conf.set(clean, before)
        sc.setCheckpointDir(base)
        removed(spark, folder)


def spread(df: DataFrame) -> DataFrame:
    """Feed CPU-bound Python work evenly: shuffle only where the input has fewer splits than there are cores, which
    is the case for small files only."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
