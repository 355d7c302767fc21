"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SIZE_CONF = "spark.sql.sources.fileCompressionFactor"
#: Bytes in memory of a byte in a Parquet file, about; columns of repeated text have more.
MEMORY_OF_FILE = 10.0


def build_session(app: str = "reelweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints.

    Only where none is named (a local test) a fresh temporary one is set, and
    kept in the session so later calls agree.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def size_files_as_memory(spark: SparkSession) -> None:
    """Tables in files count as what their rows take in memory, so that none is broadcast through the driver for being small on disk."""
    if float(spark.conf.get(SIZE_CONF)) < MEMORY_OF_FILE:
        spark.conf.set(SIZE_CONF, str(MEMORY_OF_FILE))


def materialize(df: DataFrame, label: str, spread: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches: lineage is cut and a lost
    executor costs a re-read, not a recomputation.  ``spread`` keeps one file
    per core, for small tables whose rows fan out into much work.
    """
    spark = df.sparkSession
    if spread:
        df = df.repartition(2 * spark.sparkContext.defaultParallelism)
    size_files_as_memory(spark)
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
