"""What a session of requests shares: decoded frames, index jobs and the answers that wait for events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHED_FRAMES = 8  #: decoded frames that a session keeps


def cache_hits(uses: DataFrame, most: int = CACHED_FRAMES) -> DataFrame:
    """(session_id, seq, frame_key, hit): whether the frame is among the ``most`` that the session used last, itself included.

    uses: session_id, seq, frame_key. A fold over one session's uses in order, whose state is the
    kept keys, the latest first; a null key is a key. A session's uses are one row of a task.
    """
    key = F.coalesce(F.concat(F.lit("+"), F.col("frame_key").cast("string")), F.lit("-")).alias("key")
    rows = uses.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame_key", key))).alias("uses"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("kept"), F.array().cast("array<boolean>").alias("hits"))

    def step(s: Column, u: Column) -> Column:
        kept = F.slice(F.concat(F.array(u["key"]), F.array_remove(s["kept"], u["key"])), 1, most)
        return F.struct(kept.alias("kept"), F.concat(s["hits"], F.array(F.array_contains(s["kept"], u["key"]))).alias("hits"))

    rows = rows.withColumn("hits", F.aggregate("uses", start, step)["hits"])
    found = rows.select("session_id", F.explode(F.arrays_zip("uses", "hits")).alias("u"))
    return found.select("session_id", "u.uses.seq", "u.uses.frame_key", F.col("u.hits").alias("hit"))


def shared_jobs(requests: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(request_id, job_id, starts): requests that wait at the same time and have the same key share the job of the first one.

    requests: request_id, at and the key's columns, in which null equals null.
    """
    first = requests.groupBy(*key).agg(F.min(F.struct("at", "request_id"))["request_id"].alias("job_id"))
    same = [requests[k].eqNullSafe(first[k]) for k in key]
    joined = requests.join(first, same).select("request_id", "job_id")
    return joined.withColumn("starts", F.col("request_id") == F.col("job_id"))


def routed(events: DataFrame, pending: DataFrame) -> DataFrame:
    """(seq, request_id, target): the first event of a pending request is its ``answer``; all others, of no or another request too, go on as ``event``."""
    waits = pending.select("request_id").distinct()
    first = events.join(waits, "request_id", "left_semi").groupBy("request_id").agg(F.min("seq").alias("_first"))
    rows = events.select("seq", "request_id").join(first, "request_id", "left")
    return rows.select("seq", "request_id", F.when(F.col("seq") == F.col("_first"), "answer").otherwise("event").alias("target"))
