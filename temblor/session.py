"""Session helpers shared by tests, the bench and jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str | None = None, name: str = "temblor", partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with the settings the library assumes.

    Master, shuffle partitions and memory come from the submit command unless
    named here, as tests and the bench do.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", memory or "16g").config(
            "spark.ui.enabled", "false")
    if partitions is not None or cores is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only where none is named.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and wins. The
    fallback is meant for local runs, where driver and executors share a disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="temblor-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's place of it.

    Enough where all machines have the code at one path; else ship it with the job.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    workers = spark.sparkContext.environment
    paths = [p for p in workers.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([root, *paths])
