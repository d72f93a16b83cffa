"""Error curves: smoothing, valleys and their prominence, consensus over runs, reviews, decimation.

A curve is rows (run_id, x, metric, key). Only finite points count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import c_log10

PERFECT = 1e-6  #: an error up to this is a perfect reconstruction
MOST_CATEGORIES = 120


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x)) < float("inf"))


def smoothed(points: DataFrame, window: int | None = None) -> DataFrame:
    """Adds ``i`` (0-based place by x, then key), ``n`` and ``y``: the centred mean of log10 errors, cut at the edges.

    The window is odd: 5 points from 5 on, else 3, unless given. Means of the same errors in another
    order differ in their last bit, if at all, and minima depend on it: hence the C library's log10.
    """
    points = points.where(finite("x") & finite("metric")).withColumn("level", c_log10(F.greatest(F.col("metric").cast("double"), F.lit(1e-12))))
    run = Window.partitionBy("run_id")
    order = run.orderBy("x", "key")
    points = points.withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(run)})
    mean = lambda w: F.avg("level").over(order.rowsBetween(-(w // 2), w // 2))
    y = mean(window - (window + 1) % 2) if window else F.when(F.col("n") >= 5, mean(5)).otherwise(mean(3))
    return points.withColumn("y", y).drop("level")


def local_minima(curve: DataFrame) -> DataFrame:
    """Interior points of a smoothed curve of 3 points or more that are below the one before and not above the one after."""
    order = Window.partitionBy("run_id").orderBy("i")
    low = (F.col("y") < F.lag("y").over(order)) & (F.col("y") <= F.lead("y").over(order))
    return curve.withColumn("low", low).where("low AND n >= 3").drop("low")


def horizon(n: Column) -> Column:
    return F.least(F.lit(200), F.greatest(F.lit(10), F.floor(n / 40 + 0.5))).cast("int")


def prominences(curve: DataFrame, reach: int | None = None) -> DataFrame:
    """The local minima with ``prominence``: how far the lower of the two shoulders rises above, each looked for within the horizon up to the first point that is no higher.

    Only the minima meet their neighbours, each at most two horizons of them.
    """
    h = F.lit(reach) if reach else horizon(F.col("n"))
    lows = local_minima(curve).withColumn("h", h)
    steps = lows.select("run_id", F.col("i").alias("at"), F.col("y").alias("bottom"), F.explode(F.sequence(-F.col("h"), F.col("h"))).alias("step")).where("step <> 0").withColumn("i", F.col("at") + F.col("step"))
    around = steps.join(curve.select("run_id", "i", "y"), ["run_id", "i"])
    side = around.groupBy("run_id", "at", "bottom", (F.col("step") > 0).alias("right")).agg(
        F.min(F.when(F.col("y") <= F.col("bottom"), F.abs("step"))).alias("stop"), F.collect_list(F.struct(F.abs("step").alias("gap"), "y")).alias("near")
    )
    open_part = F.filter("near", lambda p: F.col("stop").isNull() | (p["gap"] < F.col("stop")))
    shoulders = side.select("run_id", "at", "right", F.array_max(F.transform(open_part, lambda p: p["y"])).alias("top"))
    bound = shoulders.groupBy("run_id", F.col("at").alias("i")).agg(F.min("top").alias("bound"), F.count("top").alias("sides"))
    rise = F.when(F.col("sides") == 2, F.col("bound") - F.col("y")).otherwise(0.0)
    return lows.join(bound, ["run_id", "i"], "left").withColumn("prominence", F.coalesce(rise, F.lit(0.0))).drop("h", "bound", "sides")


def valleys(points: DataFrame, least: float = 0.1, window: int | None = None, reach: int | None = None) -> DataFrame:
    """(run_id, key, x, metric, prominence) of the prominent minima."""
    found = prominences(smoothed(points, window), reach)
    return found.where(F.col("prominence") >= least).select("run_id", "key", "x", "metric", "prominence")


def clusters(members: DataFrame, tolerance: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``cluster``: valleys whose gap to the one before is at most the tolerance are together.

    Valleys are few (a curve's prominent minima), so that ordering all of a group is cheap.
    """
    order = Window.partitionBy(*by).orderBy("x", "run_id", "key")
    gap = F.col("x") - F.lag("x").over(order)
    return members.withColumn("_new", F.when(gap.isNull() | (gap > tolerance), 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(order) - 1).drop("_new")


def consensus(members: DataFrame, tolerance: float = 1.0, most: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(height, score, run_count, metric, run_id, key, rank): clusters by summed prominence, runs, then height; the deepest member stands for each."""
    grouped = clusters(members, tolerance, by).groupBy(*by, "cluster").agg(
        F.sum("prominence").alias("score"), F.count_distinct("run_id").alias("run_count"), F.min(F.struct("metric", "x", "run_id", "key")).alias("deepest")
    )
    flat = grouped.select(*by, F.col("deepest.x").alias("height"), "score", "run_count", F.col("deepest.metric").alias("metric"), F.col("deepest.run_id").alias("run_id"), F.col("deepest.key").alias("key"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("run_count"), "height"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= most)


def fallback_minimum(points: DataFrame, run_order: str = "run_id", point_order: str = "x") -> DataFrame:
    """(x, metric, run_id, key) of the first lowest point, for curves without valleys."""
    best = points.where(finite("x") & finite("metric")).agg(F.min(F.struct("metric", F.col(run_order).alias("_run"), F.col(point_order).alias("_point"), "x", "run_id", "key")).alias("b"))
    return best.where("b IS NOT NULL").select("b.x", "b.metric", "b.run_id", "b.key")


def zoomed(points: DataFrame, low: float, high: float) -> DataFrame:
    """The points in the window, or all if it holds none."""
    inside = F.col("x").between(low, high)
    any_inside = points.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("_any"))
    return points.crossJoin(F.broadcast(any_inside)).where(~F.col("_any") | inside).drop("_any")


def decimated(points: DataFrame, buckets: int, order: str = "x") -> DataFrame:
    """Of each run's buckets along the order only the first lowest and first highest point; short curves stay whole."""
    run = Window.partitionBy("run_id")
    rows = points.withColumns({"_i": F.row_number().over(run.orderBy(order, "key")) - 1, "_n": F.count(F.lit(1)).over(run)})
    # the bucket whose bounds, floor(k * n / buckets), hold the point
    guess = F.floor(F.col("_i") * buckets / F.col("_n"))
    bucket = F.when(F.floor((guess + 1) * (F.col("_n") / buckets)) <= F.col("_i"), guess + 1).otherwise(guess)
    rows = rows.withColumn("_bucket", F.least(bucket, F.lit(buckets - 1)))
    ends = rows.groupBy("run_id", "_bucket").agg(F.min(F.struct("metric", "_i"))["_i"].alias("_low"), F.min(F.struct((-F.col("metric")).alias("m"), "_i"))["_i"].alias("_high"))
    kept = rows.join(ends, ["run_id", "_bucket"]).where((F.col("_n") <= 2 * buckets) | (F.col("_i") == F.col("_low")) | (F.col("_i") == F.col("_high")))
    return kept.drop("_i", "_n", "_bucket", "_low", "_high")


def worst_in_range(frames: DataFrame, low: int, high: int) -> DataFrame:
    """(run_id, frame_index, error) of the first largest error of each run's frames in the range, ends included."""
    inside = frames.where(F.col("frame_index").between(low, high) & F.col("error").isNotNull())
    worst = inside.groupBy("run_id").agg(F.min(F.struct((-F.col("error")).alias("e"), "frame_index")).alias("w"))
    return worst.select("run_id", "w.frame_index", (-F.col("w.e")).alias("error"))


def review(frames: DataFrame, threshold: float | None = None, most: int = 20) -> DataFrame:
    """The frames with the largest errors over a threshold; ties by run and frame."""
    rows = frames.where(F.col("error").isNotNull())
    if threshold is not None:
        rows = rows.where(F.col("error") > threshold)
    return rows.orderBy(F.desc("error"), "run_id", "frame_index").limit(max(1, most))


def run_comparison(points: DataFrame) -> DataFrame:
    """(run_id, n_points, x, metric, key): how many points, and the first lowest."""
    rows = points.where(finite("metric")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_points"), F.min(F.struct("metric", "x", "key")).alias("b"))
    return rows.select("run_id", "n_points", "b.x", "b.metric", "b.key")


def perfect_count(points: DataFrame) -> DataFrame:
    return points.groupBy("run_id").agg(F.count_if(F.col("metric") <= PERFECT).alias("n_perfect"))


def domain(points: DataFrame, padding: float = 0.02) -> DataFrame:
    """(low, high) of the errors with a margin on both sides."""
    ends = points.where(finite("metric")).agg(F.min("metric").alias("a"), F.max("metric").alias("b"))
    margin = (F.col("b") - F.col("a")) * padding
    return ends.select((F.col("a") - margin).alias("low"), (F.col("b") + margin).alias("high"))


def pivoted(rows: DataFrame, categories: list[str] | None = None, most: int = MOST_CATEGORIES) -> DataFrame:
    """One column per category (its lowest error in each run); of categories, the first by name up to ``most``, a report's width."""
    if categories is None:
        categories = [r[0] for r in rows.select("category").distinct().orderBy("category").limit(most).collect()]
    return rows.groupBy("run_id").pivot("category", categories).agg(F.min("metric"))


def page(rows: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows start to end, the end exclusive, of an order."""
    return rows.orderBy(*order).offset(start).limit(max(0, end - start))
