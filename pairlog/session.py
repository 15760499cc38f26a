"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "pairlog", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own session."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED = "PAIRLOG_SHIPPED"


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever the driver was started: a zip of its
    sources, sent with ``addPyFile`` once for each Spark application."""
    context = spark.sparkContext
    if context.environment.get(_SHIPPED):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pairlog-sources-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context.environment[_SHIPPED] = "1"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, stream sinks and checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only where that
    setting is absent (tests, one machine) is a local temporary folder taken.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="pairlog-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def truncate_lineage(df, purpose: str):
    """Write ``df`` to the work folder and read it back, so that later steps of an
    iterative job neither recompute nor depend on any executor's local state."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
