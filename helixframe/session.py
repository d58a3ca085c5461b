"""Session defaults for local runs; a cluster session is used as it is."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("helixframe")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HELIX_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark) -> str:
    """The folder for checkpoints and written tables: the one that the session names.

    Local runs that name none get a temporary one; a cluster has to name a folder that driver and executors share.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="helix-checkpoint-"))
    return sc.getCheckpointDir()


def scratch(spark, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/helix-{name}-{uuid.uuid4().hex}"


def stored(df):
    """``df`` as a Parquet table in the shared folder, for tables that are read more than once."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark) -> None:
    """Gives this package to the session's Python workers, once, where their path doesn't name its folder."""
    sources = os.path.dirname(os.path.abspath(__file__))
    root, app = os.path.dirname(sources), spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    target = os.path.join(tempfile.mkdtemp(prefix="helix-package-"), "helixframe")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, os.path.basename(sources)))
