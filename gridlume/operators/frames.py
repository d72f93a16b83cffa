"""Frame streams: selection, presentation order, anchors, windows, decode runs, identity matching.

Frames are rows of one stream (or of several, by ``stream`` columns) with decode_index, pts, dts,
best_effort, key_frame, rap, picture_type; operators that need frame_index take it from ``presented``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 4096  #: of places, each ordered apart


def in_scope(selection: str, every_n: int = 1, start: int | None = None, end: int | None = None, picture: str = "picture_type", key: str = "key_frame", index: str = "frame_index") -> Column:
    """``all``, ``every_n`` (counted from the start) or ``decoded_i_picture`` (the key flag where a frame has no picture type), within start to end, both included."""
    i = F.col(index)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (i >= start)
    if end is not None:
        inside = inside & (i <= end)
    if selection == "all":
        return inside
    if selection == "every_n":
        if every_n < 1:
            raise ValueError("every_n is at least 1")
        return inside & (i >= (start or 0)) & ((i - (start or 0)) % every_n == 0)
    if selection == "decoded_i_picture":
        return inside & F.coalesce(F.col(picture) == "I", F.col(key), F.lit(False))
    raise ValueError(f"no selection {selection}")


def select_frames(frames: DataFrame, *scope, **options) -> DataFrame:
    """The frames in scope; none is an error."""
    chosen = frames.where(in_scope(*scope, **options))
    if not chosen.limit(1).count():
        raise ValueError("no frame is in scope")
    return chosen


def timestamp() -> Column:
    return F.coalesce("pts", "best_effort", "dts")


def presented(frames: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``frame_index``: frames by timestamp, then decode order.

    Frames without any timestamp keep their place in decode order; the others share out the rest.
    """
    by = Window.partitionBy(*stream)
    rows = frames.withColumn("_t", timestamp()).withColumn("_slot", F.row_number().over(by.orderBy("decode_index")) - 1)
    known = Window.partitionBy(*stream, F.col("_t").isNull())
    rows = rows.withColumns({"_rank": F.row_number().over(known.orderBy("_t", "decode_index")), "_turn": F.row_number().over(known.orderBy("decode_index"))})
    slots = rows.where("_t IS NOT NULL").select(*stream, F.col("_turn").alias("_rank"), F.col("_slot").alias("_place"))
    timed = rows.where("_t IS NOT NULL").join(slots, [*stream, "_rank"]).withColumn("frame_index", F.col("_place"))
    still = rows.where("_t IS NULL").withColumn("frame_index", F.col("_slot"))
    return timed.drop("_place").unionByName(still).drop("_t", "_slot", "_rank", "_turn")


def anchored(frames: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``keyframe_anchor`` (frame_index of the latest random-access point no later in decode order, else 0) and ``leading`` (shown before it)."""
    order = Window.partitionBy(*stream).orderBy("decode_index").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.coalesce(F.last(F.when(F.col("rap"), F.col("frame_index")), ignorenulls=True).over(order), F.lit(0))
    return frames.withColumn("keyframe_anchor", anchor).withColumn("leading", F.col("frame_index") < F.col("keyframe_anchor"))


def preceding_rap(frames: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rap_before``: the random-access point strictly before each frame in decode order, or null."""
    before = Window.partitionBy(*stream).orderBy("decode_index").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("rap_before", F.last(F.when(F.col("rap"), F.col("frame_index")), ignorenulls=True).over(before))


def neighbours(frames: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``previous_key`` and ``next_key``, strictly before and after; the first and last frame where there is none."""
    order = Window.partitionBy(*stream).orderBy("frame_index")
    key = F.when(F.col("key_frame"), F.col("frame_index"))
    before = F.last(key, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(key, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("frame_index").over(Window.partitionBy(*stream))
    return frames.withColumns({"previous_key": F.coalesce(before, F.lit(0)), "next_key": F.coalesce(after, last)})


def nearest(frames: DataFrame, targets: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """Each target (stream, target_seconds) with ``frame_index`` of the nearest frame by seconds, the first of two.

    Targets and frames are merged by time within a stream, so that no target meets all frames.
    """
    place = ("_t", "_is_target", "_i")
    order, back = Window.partitionBy(*stream).orderBy(*place), Window.partitionBy(*stream).orderBy(*map(F.desc, place))
    f = frames.where("seconds IS NOT NULL").groupBy(*stream, F.col("seconds").alias("_t")).agg(F.min("frame_index").alias("_i")).withColumns({"_is_target": F.lit(0), "target_seconds": F.lit(None).cast("double")})
    t = targets.select(*stream, F.col("target_seconds").alias("_t"), F.lit(None).cast("long").alias("_i"), F.lit(1).alias("_is_target"), "target_seconds").distinct()
    rows = f.select(*stream, "_t", "_i", "_is_target", "target_seconds").unionByName(t)
    at = F.when(F.col("_is_target") == 0, F.struct("_t", "_i"))
    rows = rows.withColumns({"_a": F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last(at, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))})  # to an unbounded following each row would read all the rest
    gap = lambda c: F.abs(F.col(f"{c}._t") - F.col("target_seconds"))
    chosen = F.least(F.when(F.col("_a").isNotNull(), F.struct(gap("_a").alias("g"), F.col("_a._i").alias("i"))), F.when(F.col("_b").isNotNull(), F.struct(gap("_b").alias("g"), F.col("_b._i").alias("i"))))
    return rows.where("_is_target = 1").select(*stream, "target_seconds", chosen["i"].alias("frame_index"))


def window_of(frames: DataFrame, target: int, radius: int) -> DataFrame:
    """The frames around a target, cut at the stream's ends."""
    return frames.where(F.col("frame_index").between(target - radius, target + radius))


def decode_runs(selected: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """(run, first_frame, last_frame, frames, anchor, any_leading): selected frames that one pass decodes.

    Where at least half of the covered range is selected, one run per setup (``extradata``); else one
    per keyframe anchor too.
    """
    by = Window.partitionBy(*stream)
    order = by.orderBy("frame_index")
    rows = selected.withColumn("_dense", 2 * F.count(F.lit(1)).over(by) >= F.max("frame_index").over(by) - F.min("frame_index").over(by) + 1)
    fresh = F.lag("extradata").over(order).isNull() | (F.lag("extradata").over(order) != F.col("extradata")) | (~F.col("_dense") & (F.lag("keyframe_anchor").over(order) != F.col("keyframe_anchor")))
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("run", F.sum("_new").over(order) - 1)
    runs = rows.groupBy(*stream, "run").agg(
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        F.count(F.lit(1)).alias("frames"),
        F.min(F.struct("frame_index", "keyframe_anchor"))["keyframe_anchor"].alias("anchor"),
        F.max(F.struct(F.col("leading").cast("int").alias("l")))["l"].alias("any_leading"),
    )
    return runs.withColumn("any_leading", F.col("any_leading") == 1)


def is_monotonic(frames: DataFrame, column: str, stream: tuple[str, ...] = ()) -> DataFrame:
    """(stream, monotonic): whether the column never falls in decode order and is never null."""
    order = Window.partitionBy(*stream).orderBy("decode_index")
    rows = frames.withColumn("_ok", F.col(column).isNotNull() & F.coalesce(F.col(column) >= F.lag(column).over(order), F.lit(True)))
    return rows.groupBy(*stream).agg(F.bool_and("_ok").alias("monotonic"))


def seek_method(frames: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """(stream, method): by pts if all frames have different ones, else dts, else file position, else order."""
    unique = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.count_distinct(c) == F.count(F.lit(1)))
    agg = frames.groupBy(*stream).agg(unique("pts").alias("_p"), unique("dts").alias("_d"), unique("file_position").alias("_f"))
    method = F.when(F.col("_p"), "pts").when(F.col("_d"), "dts").when(F.col("_f"), "file_position").otherwise("sample_order")
    return agg.select(*stream, method.alias("method"))


def coverage(frames: DataFrame, scope: Column, error: str = "error", stream: tuple[str, ...] = ()) -> DataFrame:
    """(eligible, selected, processed, failed): frames, frames in scope, of these with a result, and without."""
    hit = F.coalesce(scope, F.lit(False))
    return frames.groupBy(*stream).agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(hit).alias("selected"), F.count_if(hit & F.col(error).isNotNull()).alias("processed"), F.count_if(hit & F.col(error).isNull()).alias("failed")
    )


def identity_score(decoded: str, indexed: str) -> Column:
    """How well a decoded frame fits an indexed one: 16 and 12 for presentation times, 6 for dts, 1 for the duration; 0 where both have presentation times and none agrees."""
    d, x = (lambda n: F.col(f"{decoded}.{n}")), (lambda n: F.col(f"{indexed}.{n}"))
    points = lambda a, b, w: F.when(a == b, w).otherwise(0)
    shown = points(d("pts"), x("pts"), 16) + points(d("best_effort"), x("best_effort"), 16) + points(d("best_effort"), x("pts"), 12) + points(d("pts"), x("best_effort"), 12)
    both = (d("pts").isNotNull() | d("best_effort").isNotNull()) & (x("pts").isNotNull() | x("best_effort").isNotNull())
    rest = points(d("dts"), x("dts"), 6) + F.when((d("duration") > 0) & (d("duration") == x("duration")), 1).otherwise(0)
    return F.when(both & (shown == 0), 0).otherwise(shown + rest)


def matched(decoded: DataFrame, index: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """(stream, decoded_id, frame_index, score, problem): each decoded frame's best indexed one of its stream.

    Where several indexed frames share the best score the match is ambiguous: the frame index is
    null and the problem says so. Frames meet on equal times instead of all with all; one that
    shares no time matches none.
    """
    times = lambda df: df.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array(*(F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("p", "pts"), ("p", "best_effort"), ("d", "dts"))))))))
    left = times(decoded).select(*stream, "_key", "decoded_id", F.struct("pts", "best_effort", "dts", "duration").alias("d"))
    right = times(index).select(*stream, "_key", "frame_index", F.struct("pts", "best_effort", "dts", "duration").alias("x"))
    pairs = left.join(right, [*stream, "_key"]).select(*stream, "decoded_id", "frame_index", identity_score("d", "x").alias("score")).distinct().where("score > 0")
    scores = pairs.groupBy(*stream, "decoded_id", "score").agg(F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("frame_index"))
    best = scores.groupBy(*stream, "decoded_id").agg(F.max(F.struct("score", "n", "frame_index")).alias("b"))
    one = F.col("b.n") == 1
    return best.select(*stream, "decoded_id", F.when(one, F.col("b.frame_index")).alias("frame_index"), "b.score", F.when(~one, "ambiguous_timestamps").alias("problem"))


def ordered_subset_problem(selected: DataFrame, frames: DataFrame) -> DataFrame:
    """(place, problem) of selected frames that aren't strictly ascending or don't exist; ``selected`` is (place, frame_index).

    Places are dealt into RANGES equal ranges, so that no task orders all; a range's first frame
    follows the last one of the ranges before it.
    """
    ends = selected.agg(F.min("place").cast("double").alias("_low"), F.max("place").cast("double").alias("_high"))
    part = F.floor((F.col("place").cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * RANGES)
    rows = selected.crossJoin(F.broadcast(ends)).select("place", "frame_index", F.coalesce(part, F.lit(-1)).alias("_range"))
    lasts = rows.groupBy("_range").agg(F.max(F.struct("place", "frame_index"))["frame_index"].alias("_last"))
    lasts = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    order = Window.partitionBy("_range").orderBy("place", "frame_index")
    before = F.when(F.row_number().over(order) == 1, F.col("_carried")).otherwise(F.lag("frame_index").over(order))
    rows = rows.join(F.broadcast(lasts), "_range").withColumn("_before", before).join(frames.select("frame_index", F.lit(True).alias("_exists")), "frame_index", "left")
    problem = F.when(F.col("_exists").isNull(), "missing").when(F.col("frame_index") <= F.col("_before"), "not_ascending")
    return rows.select("place", problem.alias("problem")).where("problem IS NOT NULL")


def presentation_mismatches(decoded: DataFrame, index: DataFrame, stream: tuple[str, ...] = ()) -> DataFrame:
    """(stream, frame_index) of decoded frames whose pts, where both are known, isn't the index's."""
    pairs = decoded.select(*stream, "frame_index", F.col("pts").alias("_decoded")).join(index.select(*stream, "frame_index", "pts"), [*stream, "frame_index"])
    return pairs.where("_decoded <> pts").select(*stream, "frame_index")
