"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of its own in a local session only."""
    folder = spark.conf.get(CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CONF} to a folder that the driver and every executor can reach")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(CONF, folder)
    return folder.rstrip("/")


class Folder:
    """The tables of one run. Reading one back cuts lineage; a lost executor costs a read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._drop: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, name: str, before: DataFrame | None) -> DataFrame:
        """Write ``df`` and remove the table ``before`` that it came from."""
        fresh = self.write(df, name)
        if before is not None:
            for path in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
                self.remove(path)
        return fresh

    def remove(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
