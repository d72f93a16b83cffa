"""Rounding and comparison rules that the engine's results depend on, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def half_even(x: Column) -> Column:
    """Nearest integer, halves to the even one (``rint``; ``round`` would go up)."""
    return F.rint(x.cast("double")).cast("long")


def toward_zero(x: Column) -> Column:
    return x.cast("double").cast("long")


def grid_round(x: Column) -> Column:
    """Half up, without the step that adding 0.5 makes just below a half."""
    return F.when(x < 0, F.floor(x + 0.5)).otherwise(F.floor(x + 0.49999999999999994)).cast("long")


def round_scaled(x: Column, places: int) -> Column:
    """Rounded as SQL and C do it: the product with the power of ten, halves away from zero. ``round`` goes by the shortest decimal, 0.03695 to 0.037 though the double is less."""
    return F.round(x * 10.0**places) / 10.0**places


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers up to a millionth of the larger (at least 1), or else as text; null only equals null."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(near, a.cast("string") == b.cast("string")))


def nice_step(raw: Column) -> Column:
    """The smallest of 1, 2, 2.5, 5 and 10 times a power of ten that is no less than ``raw``; 0 of 0, whose power is 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    steps = F.when(part <= 1, 1.0)
    for s in (2.0, 2.5, 5.0):
        steps = steps.when(part <= s, s)
    return F.when(raw == 0, 0.0).otherwise(steps.otherwise(10.0) * power)


def display_log(metric: Column) -> Column:
    return F.log10(metric + 1e-9)


def floored_log(metric: Column) -> Column:
    """log10 of an error, which may be 0."""
    return F.log10(F.greatest(metric, F.lit(1e-12)))


@F.pandas_udf(DoubleType())
def c_log10(x: pd.Series) -> pd.Series:
    """log10 to the last bit as the C library has it; the JVM's is another double for one value in a hundred, by which ties of sums come out differently."""
    return pd.Series(np.fromiter(map(math.log10, x), np.float64, len(x)))


def decimal_text(x: Column) -> Column:
    """An exact decimal without zeros at its end."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


@F.pandas_udf(StringType())
def digits17(x: pd.Series) -> pd.Series:
    """A double with 17 significant digits at most, as C's ``%.17g``; Spark has only the shortest text that reads back."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.17g}")


def seconds_of_ticks(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """Ticks of a rational time base; null without ticks or with a base of 0."""
    return F.when(denominator != 0, ticks.cast("double") * numerator.cast("double") / denominator.cast("double"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return 0.2126 * red + 0.7152 * green + 0.0722 * blue


def code_to_luma(code: Column, depth: Column) -> Column:
    """A luma sample of ``depth`` bits on the scale of 16 bits, 0 to 1; the range flag doesn't count."""
    return (code.cast("double") * F.pow(F.lit(2.0), 16 - depth) / 65535.0).cast("float")


def bounded_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """The largest size of the same shape that fits into a square of ``most``; never larger than before, at least 1."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height).cast("double"))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("long")
    return side(width), side(height)
