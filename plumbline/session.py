"""Session defaults used by tests, the bench and the entry point."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions stay Spark's default unless given."""
    b = (
        SparkSession.builder.master(master)
        .appName("plumbline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the one that driver and executors share (``spark.checkpoint.dir``).

    A single-process session without that setting gets a temporary folder; a cluster must have it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """What is read or run herein has this setting."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def few_listing_tasks(spark: SparkSession):
    """Readers that are made herein list their folders by a few tasks for each core, not by a task for each folder."""
    return setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)


def same_ranges(spark: SparkSession):
    """All scans herein cut files to the same byte ranges, also when executors come or go meanwhile."""
    n = next(filter(None, (spark.conf.get(f"spark.sql.{k}", None) for k in ("files.minPartitionNum", "leafNodeDefaultParallelism"))), spark.sparkContext.defaultParallelism)
    return setting(spark, "spark.sql.files.minPartitionNum", n)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once, however often it is read."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
