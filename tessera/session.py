"""Session helpers that hold for a laptop and for a cluster alike."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "tessera", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use: UTC, adaptive execution, few partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints and staged tables that all executors reach: the one that ``spark.checkpoint.dir`` names.

    A temporary one is made only where none is set and all runs on one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables in ``sf_dir``, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
