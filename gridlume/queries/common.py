"""How the fixed tables stand in for curves, frame streams, runs and recipes; each as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order are a run's error curve."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), place.cast("double").alias("x"), F.col("value").alias("metric"), F.col("event_id").cast("string").alias("key"))


CURVE = """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS x,
 value AS metric, CAST(event_id AS VARCHAR) AS key FROM events"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are a video stream, shown in another order than decoded; purchases have no time, errors no result."""
    rows = table(spark, sf_dir, "events").withColumn("decode_index", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    turn = F.expr("CASE decode_index % 4 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN -1 ELSE 0 END")
    return rows.select(
        F.col("user_id").alias("stream"),
        "event_id",
        F.col("decode_index").cast("long").alias("decode_index"),
        F.when(F.col("event_type") != "purchase", F.col("decode_index") + turn).cast("long").alias("pts"),
        F.lit(None).cast("long").alias("best_effort"),
        F.when(F.col("event_type") != "purchase", F.col("decode_index") * 2).cast("long").alias("dts"),
        F.col("event_id").alias("file_position"),
        (F.col("event_type") == "signup").alias("key_frame"),
        (F.col("event_type") == "signup").alias("rap"),
        F.expr("CASE event_type WHEN 'signup' THEN 'I' WHEN 'view' THEN 'P' WHEN 'click' THEN 'B' END").alias("picture_type"),
        (F.col("event_id") % 7 == 0).cast("int").alias("extradata"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("error"),
    )


STREAM = """SELECT user_id AS stream, event_id, decode_index,
 CASE WHEN event_type <> 'purchase' THEN decode_index + CASE decode_index % 4 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN -1 ELSE 0 END END AS pts,
 CAST(NULL AS BIGINT) AS best_effort, CASE WHEN event_type <> 'purchase' THEN decode_index * 2 END AS dts, event_id AS file_position,
 event_type = 'signup' AS key_frame, event_type = 'signup' AS rap,
 CASE event_type WHEN 'signup' THEN 'I' WHEN 'view' THEN 'P' WHEN 'click' THEN 'B' END AS picture_type,
 CAST(event_id % 7 = 0 AS INTEGER) AS extradata, CASE WHEN event_type <> 'error' THEN value END AS error
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS decode_index FROM events)"""

#: Frames without a time keep their slot; the others take the remaining slots by time.
PRESENTED = f"""SELECT s.*, CASE WHEN t IS NULL THEN decode_index ELSE slot END AS frame_index FROM (
 SELECT *, row_number() OVER (PARTITION BY stream, t IS NULL ORDER BY t, decode_index) AS rnk FROM (SELECT *, coalesce(pts, best_effort, dts) AS t FROM ({STREAM}))) s
 LEFT JOIN (SELECT stream, decode_index AS slot, row_number() OVER (PARTITION BY stream ORDER BY decode_index) AS turn
  FROM ({STREAM}) WHERE coalesce(pts, best_effort, dts) IS NOT NULL) k ON s.stream = k.stream AND s.t IS NOT NULL AND s.rnk = k.turn"""


def rounded(name: str, places: int = 6):
    return F.round(name, places).alias(name)
