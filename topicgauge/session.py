"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import topicgauge

# Settings the jobs are written for; shuffle partitions are left to the cluster
# (AQE coalesces them), so size them to the data there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Vector sums run as object aggregates; keep them hashed for many topics
    # instead of falling back to a sort after 128 keys.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("topicgauge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession) -> None:
    """The settings above that a running session can still change."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions run in Python workers import it there, whatever folder the
    driver was started in.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(topicgauge.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="topicgauge-"), "topicgauge.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="topicgauge-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and stays columnar so later
    passes read only the columns they use, and of the folders `by` only theirs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/topicgauge/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.partitionBy(*by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    # Spark puts the columns of the folders last.
    return back.select(df.columns) if by else back


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops what `materialize` wrote inside the block once the block is done.

    For jobs that end by writing their result; frames read from inside the
    block are of no use after it.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and the row order inside them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores, ahead of work that is heavy per row.

    A table of one row group scans as one task whatever its splits say. Inputs
    with more splits than cores are left as they are, so large data never
    shuffles for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, limit_bytes: int, vector: str | None = None) -> DataFrame:
    """Broadcast `df` only when its measured size is under the limit.

    Size is rows times 200 bytes for ids and numbers, plus 8 bytes per element
    of the widest `vector`. Past the limit the join is left to shuffle, with
    AQE splitting hot keys.
    """
    width = F.max(F.size(vector)) if vector else F.lit(0)
    size = df.agg(F.count(F.lit(1)).alias("rows"), width.alias("dims")).first()
    if size["rows"] * (200 + 8 * (size["dims"] or 0)) <= limit_bytes:
        return F.broadcast(df)
    return df
