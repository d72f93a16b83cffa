"""Plans as a table: requests once each, built by tasks, kept as Parquet and reused."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import axis

#: Changes with the arithmetic of plans, so that old ones aren't reused.
BUILD = "axis-2"
MOST_BYTES = 1 << 30  #: of a store, by the files used last
KEY = ("source_size", "destination_size", "active_length", "shift", "kernel_id", "b", "c", "taps")
KEY_DDL = "source_size INT, destination_size INT, active_length DOUBLE, shift DOUBLE, kernel_id STRING, b DOUBLE, c DOUBLE, taps INT"
PLAN_DDL = f"{KEY_DDL}, plan BINARY, half_bandwidth INT, plan_bytes BIGINT, problem STRING"


def axis_requests(geometry: str, kernel: str, frame_size, horizontal: bool) -> dict:
    """Request columns of one axis of a geometry column for frames of a size; parameters that don't matter are the same for all."""
    g, k = F.col(geometry), F.col(kernel)
    names = ("width", "src_width", "src_left") if horizontal else ("height", "src_height", "src_top")
    return {
        "source_size": frame_size.cast("int"),
        "destination_size": g[names[0]].cast("int"),
        "active_length": g[names[1]],
        "shift": g[names[2]],
        "kernel_id": k["id"],
        "b": F.when(k["id"] == "bicubic", F.coalesce(k["b"], F.lit(0.0))).otherwise(0.0),
        "c": F.when(k["id"] == "bicubic", F.coalesce(k["c"], F.lit(0.5))).otherwise(0.5),
        "taps": F.when(k["id"] == "lanczos", F.coalesce(k["taps"], F.lit(3))).otherwise(3),
    }


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key in batch[list(KEY)].itertuples(index=False):
            request = axis.Request(int(key[0]), int(key[1]), *key[2:7], int(key[7]))
            plan = None if request.problem() else axis.build(request)
            rows.append((*key, plan and plan.to_bytes(), plan and plan.half_bandwidth, plan and plan.nbytes(), request.problem()))
        yield pd.DataFrame(rows, columns=[*KEY, "plan", "half_bandwidth", "plan_bytes", "problem"])


def build_plans(requests: DataFrame) -> DataFrame:
    """One row per distinct request, with its plan or its problem."""
    distinct = requests.select(*KEY).distinct()
    return distinct.repartition("source_size", "destination_size", "active_length", "kernel_id").mapInPandas(_build, PLAN_DDL)


def attach_plans(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """Each request with its plan, repeats included, in whatever order the request's own columns give."""
    return requests.join(plans, list(KEY), "left")


def grid_hash(requests: DataFrame) -> DataFrame:
    """(grid_hash) of a set of requests: the same for any order and any repeats."""
    whole = [F.count(F.lit(1)), *(F.coalesce(F.bit_xor(F.xxhash64(F.lit(salt), *KEY)), F.lit(0)) for salt in (0, 1))]
    return requests.select(*KEY).distinct().agg(F.xxhash64(*whole).alias("grid_hash"))


def ensure_plans(requests: DataFrame, path: str, most_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(plans of the requests from the store, how many had to be built).

    With ``most_bytes`` files used longest ago go first, before new plans come, and files that serve
    this call count as used now. The store is Parquet by build and kernel, so that a lookup reads only those; requests that it
    has aren't built again, and plans of another build aren't read.
    """
    spark = requests.sparkSession
    wanted = requests.select(*KEY).distinct()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    held = None
    if place.getFileSystem(conf).exists(place):
        held = spark.read.schema(f"{PLAN_DDL}, build STRING").parquet(path).where(F.col("build") == BUILD)
    if most_bytes is not None and held is not None:
        touch(held.select(*KEY, F.col("_metadata.file_path").alias("file")).join(wanted, list(KEY), "left_semi"))
        evict(spark, path, most_bytes)
        held = spark.read.schema(f"{PLAN_DDL}, build STRING").parquet(path).where(F.col("build") == BUILD)
    missing = wanted if held is None else wanted.join(held.select(*KEY), list(KEY), "left_anti")
    count = missing.count()
    if count:
        build_plans(missing).withColumn("build", F.lit(BUILD)).write.mode("append").partitionBy("build", "kernel_id").parquet(path)
    stored = spark.read.schema(f"{PLAN_DDL}, build STRING").parquet(path).where(F.col("build") == BUILD)
    return stored.join(wanted, list(KEY), "left_semi").drop("build"), count


def evict(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> int:
    """Delete the store's files that were written or asked for longest ago until the rest fits; how many went.

    The driver lists the store's files, which its size bounds; plans that are gone are built again.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    found, listed = [], system.listFiles(place, True) if system.exists(place) else None
    while listed is not None and listed.hasNext():
        status = listed.next()
        if status.getPath().getName().endswith(".parquet"):
            found.append((status.getModificationTime(), status.getPath().toString(), status.getLen()))
    held, gone = 0, 0
    for _, name, size in sorted(found, reverse=True):
        held += size
        if held > most_bytes:
            gone += bool(system.delete(jvm.org.apache.hadoop.fs.Path(name), False))
    return gone


def touch(used: DataFrame) -> None:
    """Mark the files of a ``file`` column as used now."""
    spark = used.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in used.select("file").distinct().collect():  # files of one store
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row.file)
        place.getFileSystem(conf).setTimes(place, int(time.time() * 1000), -1)
