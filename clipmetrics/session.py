"""Session settings, working folders and written intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    paths = context.environment.get("PYTHONPATH", "")
    if str(root) in paths.split(os.pathsep):
        return
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, str(root)]))
    if not context.master.startswith("local"):
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='run-ship-')}/clipmetrics", "zip", root, "clipmetrics")
        context.addPyFile(archive)  # Spark itself copies it to every executor


def build_session(app: str = "clipmetrics", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-clipmetrics-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/clipmetrics/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
