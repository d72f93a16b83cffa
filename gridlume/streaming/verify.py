"""Verification of frame streams, and the state machines beside it.

Frames come in order of ``seq`` per stream. There is no event time: a gap is an error, not lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scans

FRAME_STREAM_DDL = "stream_id STRING, seq BIGINT, frame_id BIGINT, width INT, height INT, pixels ARRAY<FLOAT>"
EVENT_DDL = "job_id STRING, seq BIGINT, event STRING, completed BIGINT, total BIGINT"
TERMINAL = {"result": "completed", "cancelled": "cancelled", "error": "failed", "partial": "partial"}


def read_frames(spark: SparkSession, path: str, files_per_batch: int = 2) -> DataFrame:
    """A stream of frame files; ``files_per_batch`` bounds what is in flight."""
    return spark.readStream.schema(FRAME_STREAM_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_commands(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.readStream.schema(ddl).json(path)


def verify_stream(frames: DataFrame, geometry: Column, kernel: Column, width: int, height: int, axis_mode: str = "h_plus_w", metric: dict | None = None) -> DataFrame:
    """(stream_id, seq, error, problem) of a stream of frames of one shape; a bad frame has a null error and the stream goes on."""
    work = F.array(F.struct(F.lit(0).alias("ordinal"), geometry.alias("geometry"), kernel.alias("kernel")))
    rows = frames.select(F.struct("stream_id", "seq").alias("at"), F.col("frame_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), "pixels", work.alias("works"))
    inner = scans._run(axis_mode, metric or scans.DEFAULT_METRIC, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for found in inner(iter([batch])):
                at = [a if isinstance(a, dict) else a.asDict() for a in batch["at"]]
                yield pd.DataFrame({"stream_id": [a["stream_id"] for a in at], "seq": [a["seq"] for a in at], "error": found["error"].values, "problem": found["problem"].values})

    return rows.mapInPandas(run, "stream_id STRING, seq BIGINT, error DOUBLE, problem STRING")


def write_in_order(results: DataFrame, path: str, checkpoint: str):
    """Each micro-batch sorted by stream and seq, under its own number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.orderBy("stream_id", "seq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _sequence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    expected = state.get[0] if state.exists else 0
    rows = []
    for seq in sorted(s for b in batches for s in b["seq"]):
        accepted = seq == expected
        rows.append((key[0], int(seq), accepted, None if accepted else "duplicate" if seq < expected else "gap"))
        expected += accepted
    state.update((expected,))
    yield pd.DataFrame(rows, columns=["stream_id", "seq", "accepted", "problem"])


def contiguous(frames: DataFrame) -> DataFrame:
    """(stream_id, seq, accepted, problem): seq must go 0, 1, 2, ... per stream; what doesn't fit is rejected and the stream stays usable."""
    return frames.select("stream_id", "seq").groupBy("stream_id").applyInPandasWithState(_sequence, "stream_id STRING, seq BIGINT, accepted BOOLEAN, problem STRING", "expected BIGINT", "append", GroupStateTimeout.NoTimeout)


def _generations(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else -1
    rows = []
    for seq, generation in sorted((s, g) for b in batches for s, g in zip(b["seq"], b["generation"])):
        fresh = generation > last
        rows.append((int(key[0]), int(seq), int(generation), bool(fresh)))
        last = max(last, generation)
    state.update((int(last),))
    yield pd.DataFrame(rows, columns=["slot", "seq", "generation", "accepted"])


def slot_reuse(frames: DataFrame) -> DataFrame:
    """(slot, seq, generation, accepted): a ring's slot may only be used again with a larger generation."""
    return frames.select("slot", "seq", "generation").groupBy("slot").applyInPandasWithState(_generations, "slot INT, seq BIGINT, generation BIGINT, accepted BOOLEAN", "last BIGINT", "append", GroupStateTimeout.NoTimeout)


def _reduce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    phase, completed, total, last = state.get if state.exists else ("queued", 0, 0, -1)
    rows = sorted((int(r.seq), r.event, r.completed, r.total) for b in batches for r in b.itertuples(index=False))
    for seq, event, done, of in rows:
        if seq <= last:
            continue
        last = seq
        if phase not in ("queued", "running"):
            continue
        if event in TERMINAL:
            phase = TERMINAL[event]
        elif event in ("started", "progress"):
            phase = "running"
        if done is not None and not pd.isna(done):
            completed = max(completed, int(done))
        if of is not None and not pd.isna(of):
            total = max(total, int(of))
    state.update((phase, completed, total, last))
    yield pd.DataFrame([(key[0], phase, completed, total)], columns=["job_id", "phase", "completed", "total"])


def reduce_events(events: DataFrame) -> DataFrame:
    """(job_id, phase, completed, total) after each batch of events: queued, running, then one of the ends, which nothing changes any more; counts never fall."""
    return events.groupBy("job_id").applyInPandasWithState(_reduce, "job_id STRING, phase STRING, completed BIGINT, total BIGINT", "phase STRING, completed BIGINT, total BIGINT, last BIGINT", "update", GroupStateTimeout.NoTimeout)


def sequence_problems(frames: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(stream_id, problem) of a whole stream: a first seq other than 0, gaps, repeats, or another total than declared. Batch form of ``contiguous``."""
    rows = frames.groupBy("stream_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("seq").alias("n"), F.count_distinct("seq").alias("distinct"))
    problem = F.when(F.col("low") != 0, "not_from_zero").when(F.col("n") != F.col("distinct"), "repeated").when(F.col("high") + 1 != F.col("distinct"), "gap")
    if declared is not None:
        rows = rows.join(declared.select("stream_id", F.col("total").alias("declared")), "stream_id", "outer")
        problem = F.coalesce(problem, F.when(F.coalesce("n", F.lit(0)) != F.col("declared"), "total_mismatch"))
    return rows.select("stream_id", problem.alias("problem")).where("problem IS NOT NULL")


def reduced(events: DataFrame) -> DataFrame:
    """(job_id, phase, completed, total) of whole event tables: the first end counts, and counts up to it. Batch form of ``reduce_events``."""
    ends = events.where(F.col("event").isin(*TERMINAL)).groupBy("job_id").agg(F.min("seq").alias("end"))
    rows = events.join(ends, "job_id", "left").where(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    named = F.max(F.when(F.col("seq") == F.col("end"), F.col("event")))
    phase = F.lit(None).cast("string")
    grouped = rows.groupBy("job_id").agg(named.alias("e"), F.coalesce(F.max("completed"), F.lit(0)).alias("completed"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.bool_or(F.col("event").isin("started", "progress")).alias("ran"))
    for event, end in TERMINAL.items():
        phase = F.when(F.col("e") == event, end).otherwise(phase)
    return grouped.select("job_id", F.coalesce(phase, F.when(F.col("ran"), "running").otherwise("queued")).alias("phase"), "completed", "total")


def throttled(frames: DataFrame, milliseconds: int = 200) -> DataFrame:
    """(window_start, frames, last_seq) per tumbling window of ``ts``: what a display is told."""
    return frames.groupBy(F.window("ts", f"{milliseconds} milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.max("seq").alias("last_seq")).select(F.col("w.start").alias("window_start"), "frames", "last_seq")


def resumed(frames: DataFrame, done: DataFrame) -> DataFrame:
    """What is left after a decoder failed: frames of each stream after its completed prefix."""
    ends = done.groupBy("stream_id").agg(F.max("seq").alias("done_to"))
    return frames.join(ends, "stream_id", "left").where(F.col("seq") > F.coalesce("done_to", F.lit(-1))).drop("done_to")
