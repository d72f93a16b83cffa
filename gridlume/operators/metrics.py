"""The error of a reconstruction: a cropped, strictly thresholded p-norm of the differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_NORM = 4_294_967_295
CROP = ("crop_left", "crop_right", "crop_top", "crop_bottom")


def empty(width: int, height: int, crop: tuple[int, int, int, int]) -> bool:
    """Whether a crop of (left, right, top, bottom) keeps nothing."""
    left, right, top, bottom = crop
    return left + right >= width or top + bottom >= height


def bounds(width: int, height: int, crop: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """(left, right, top, bottom) of what a crop of (left, right, top, bottom) keeps; nothing left is an error."""
    left, right, top, bottom = crop
    if min(crop) < 0 or empty(width, height, crop):
        raise ValueError("crop leaves no pixel")
    return left, width - right, top, height - bottom


def p_norm(difference: np.ndarray, threshold: float, norm: int) -> float:
    """(sum of d^p over d > threshold / number of all differences)^(1/p); powers up to 4 in 32 bits, sums in 64."""
    d = np.abs(difference, dtype=np.float32)
    d = d[d > np.float32(threshold)]
    if not len(d):
        return 0.0
    if norm <= 4:
        power = d
        for _ in range(norm - 1):
            power = power * d
        mean = float(power.sum(dtype=np.float64)) / difference.size
        return mean if norm == 1 else mean ** (1 / norm)
    most = float(d.max())
    scaled = np.sum((d.astype(np.float64) / most) ** norm)
    return most * float(scaled / difference.size) ** (1 / norm)


def cropped(width: Column, height: Column, x: Column, y: Column, crop: Column) -> Column:
    """Whether a pixel is within the crop."""
    return (x >= crop["crop_left"]) & (x < width - crop["crop_right"]) & (y >= crop["crop_top"]) & (y < height - crop["crop_bottom"])


def p_norm_agg(difference: Column, threshold: float, norm: int) -> Column:
    """The same over pixel rows, as one aggregate: any norm is scaled by the largest difference, so powers don't vanish.

    For use after the crop's filter, in ``groupBy().agg``; a group without rows gives null.
    """
    d = F.abs(difference.cast("float")).cast("double")
    kept = F.when(d > float(np.float32(threshold)), d)
    if norm <= 4:
        total = F.coalesce(F.sum(F.pow(kept, norm)), F.lit(0.0)) / F.count(difference)
        return total if norm == 1 else F.pow(total, 1.0 / norm)
    raise ValueError("norms above 4 need the largest difference first: see p_norm_scaled")


def p_norm_scaled(rows, key: str, difference: str, threshold: float, norm: int):
    """(key, error) for any norm, in two aggregations: the largest kept difference, then the scaled powers."""
    d = F.abs(F.col(difference).cast("float")).cast("double")
    rows = rows.select(key, F.when(d > float(np.float32(threshold)), d).alias("d"))
    most = rows.groupBy(key).agg(F.max("d").alias("most"))
    scaled = rows.join(most, key).groupBy(key, "most").agg((F.coalesce(F.sum(F.pow(F.col("d") / F.col("most"), float(norm))), F.lit(0.0)) / F.count(F.lit(1))).alias("mean"))
    return scaled.select(key, F.when(F.col("most").isNull(), 0.0).otherwise(F.col("most") * F.pow("mean", F.lit(1.0 / norm))).alias("error"))


def p_norm_in_order(rows: DataFrame, key: str, place: str, difference: str, threshold: float, norm: int, block: int = 256) -> DataFrame:
    """(key, error) by partial sums of ``block`` consecutive places, added up in the order of the blocks: the same bits however rows are dealt.

    A group of blocks is one pixel row or so of a task, and then one row a block.
    """
    d = F.abs(F.col(difference).cast("double"))
    parts = rows.select(key, F.floor(F.col(place) / block).alias("_block"), F.struct(F.col(place).alias("place"), F.when(d > threshold, F.pow(d, float(norm))).otherwise(0.0).alias("value")).alias("_item"))
    add = lambda items, value: F.aggregate(F.array_sort(items), F.lit(0.0), lambda s, e: s + e[value])
    parts = parts.groupBy(key, "_block").agg(add(F.collect_list("_item"), "value").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    whole = parts.groupBy(key).agg(add(F.collect_list(F.struct("_block", "_sum")), "_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return whole.select(key, F.pow(F.col("_sum") / F.col("_n"), F.lit(1.0 / norm)).alias("error"))


def problem(crops: list[Column], threshold: Column, norm: Column) -> Column:
    """Why a metric can't be used, or null."""
    negative = F.lit(False)
    for c in crops:
        negative = negative | F.coalesce(c < 0, F.lit(True))
    return (
        F.when(negative, "crop_negative")
        .when(F.coalesce((threshold < 0) | F.isnan(threshold), F.lit(True)), "threshold_negative")
        .when(F.coalesce((norm < 1) | (norm > MOST_NORM), F.lit(True)), "norm_out_of_range")
    )


def metric_key(metric: str) -> Column:
    """Equal for metrics whose errors can be compared."""
    parts = [F.col(f"{metric}.{c}").cast("string") for c in CROP]
    return F.concat_ws("|", *parts, F.col(f"{metric}.threshold").cast("string"), F.col(f"{metric}.norm").cast("string"))


def metric_difference(a: str, b: str) -> Column:
    """The first part in which two metrics differ, or null."""
    crop = F.lit(False)
    for c in CROP:
        crop = crop | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return (
        F.when(crop, "crop_mismatch")
        .when(~F.col(f"{a}.threshold").eqNullSafe(F.col(f"{b}.threshold")), "threshold_mismatch")
        .when(~F.col(f"{a}.norm").eqNullSafe(F.col(f"{b}.norm")), "norm_mismatch")
    )
