"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it may be unset, one of our own."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


class Scratch:
    """Parquet tables that cut lineage: a lost executor costs a reread, never a recomputation.

    The folder goes when the session's driver ends, as results may be read lazily from it;
    ``drop`` frees a table earlier.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quietly_clear(self) -> None:
        if self.spark.sparkContext._jsc is None:  # the session has ended
            return
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  at interpreter exit the JVM may be gone already
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def release(self) -> None:
        """Have the driver collect its garbage: shuffle files of what has been saved go only then."""
        self.spark.sparkContext._jvm.System.gc()
