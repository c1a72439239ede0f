"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What one Arrow batch between Spark and Python may hold. A worker keeps a few copies of a batch, so this and not the table bounds its memory.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by rows and, for long rows, by bytes."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)


def build_session(app: str = "docloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings given by spark-submit win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    bound_batches(spark)
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder every executor can reach.

    It lies below the folder the cluster names in ``spark.checkpoint.dir``; a private one is made only
    where that is unset and the master is local; a cluster without the setting is an error, since each
    machine would read back only what it wrote itself.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docloom-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to a table in the shared folder and go on from there.

    Lost executors then cost a re-read instead of a recompute, later reads take only the columns they
    need, and nothing is computed twice to be saved.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, wherever the driver was started."""
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    if getattr(context, "_docloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="docloom-package-")
    archive = shutil.make_archive(os.path.join(folder, "docloom"), "zip", root_dir=package.parent, base_dir=package.name)
    context.addPyFile(archive)
    context._docloom_shipped = True
