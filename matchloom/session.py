"""Session and shared-folder helpers."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "matchloom", cpus: int | None = None) -> SparkSession:
    """Local session for tests and bench; on a cluster use the submitted one."""
    n = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # rows here are cheap to store but costly to score: keep small shuffles on all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.matchloom.textPartitions", str(n))  # test tables are single files
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; harmless where they have it already."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-"), "matchloom")
    sc.addPyFile(shutil.make_archive(name, "zip", root, "matchloom"))


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    Uses ``spark.checkpoint.dir``. Only a local master may fall back to /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df, purpose: str):
    """Cut the lineage by writing to the shared folder and reading it back.

    Unlike an executor-local checkpoint the files outlive a lost executor.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
