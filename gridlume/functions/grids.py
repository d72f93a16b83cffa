"""Candidate grids: table functions over decimal start, stop and step.

A candidate's id is its exact decimal text; its value follows the profile's arithmetic, so that
the two may differ in the last bits and, for sums, in how many there are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbers import decimal_text

SEMANTICS = ("decimal_fixed_point", "index_multiplication", "repeated_addition")
MOST_CANDIDATES = 100_000
#: Fixed values: (profile_id, semantics, start, stop, step, crop, threshold, kernel, b, c, taps).
PROFILES = (
    ("accumulated", "repeated_addition", "500", "1000", "1", 5, 0.015, "bicubic", 0.0, 0.5, 3),
    ("indexed", "index_multiplication", "500", "1000", "0.25", 10, 0.015, "bicubic", 0.0, 0.5, 3),
    ("exact", "decimal_fixed_point", "500", "1000", "1", 5, 0.015, "bicubic", 0.0, 0.5, 3),
)
PROFILE_DDL = "profile_id STRING, semantics STRING, start STRING, stop STRING, step STRING, crop INT, threshold DOUBLE, kernel_id STRING, b DOUBLE, c DOUBLE, taps INT"


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), PROFILE_DDL)


def profile(profile_id: str) -> dict:
    names = [p.split()[0] for p in PROFILE_DDL.split(", ")]
    found = [dict(zip(names, p)) for p in PROFILES if p[0] == profile_id]
    if not found:
        raise ValueError(f"no profile {profile_id}")
    return found[0]


def _steps(start: Decimal, stop: Decimal, step: Decimal, inclusive: bool) -> int:
    if not step > 0:
        raise ValueError("step must be positive")
    whole = (stop - start) // step
    return max(0, int(whole) + (1 if inclusive or start + whole * step < stop else 0)) if stop >= start else 0


def _decimals(spark: SparkSession, n: int, start: Decimal, step: Decimal) -> DataFrame:
    scale = max(0, -min(start.as_tuple().exponent, step.as_tuple().exponent))
    whole = lambda x: F.lit(int(x.scaleb(scale)))
    return spark.range(n).select(F.col("id").cast("int").alias("ordinal"), ((whole(start) + F.col("id") * whole(step)).cast("decimal(28,0)") / F.lit(Decimal(10) ** scale).cast("decimal(20,0)")).cast(f"decimal(30,{scale})").alias("exact"))


def candidate_range(spark: SparkSession, start: str, stop: str, step: str, inclusive: bool = True, semantics: str = "decimal_fixed_point", most: int = MOST_CANDIDATES) -> DataFrame:
    """(ordinal, candidate_id, value) from start to stop.

    ``decimal_fixed_point`` counts in exact units; ``index_multiplication`` is start + i * step in
    doubles; ``repeated_addition`` adds the step again and again. The stop is compared with the
    value of that arithmetic. An empty range, or one of more than ``most``, is an error.
    """
    a, b, s = (Decimal(x) for x in (start, stop, step))
    if semantics not in SEMANTICS:
        raise ValueError(f"no grid semantics {semantics}")
    n = _steps(a, b, s, inclusive)
    if n > most:
        raise ValueError(f"more than {most} candidates")
    grid = _decimals(spark, n + 2, a, s)
    if semantics == "decimal_fixed_point":
        grid = grid.where(F.col("ordinal") < n).withColumn("value", F.col("exact").cast("double"))
    elif semantics == "index_multiplication":
        grid = grid.withColumn("value", float(a) + F.col("ordinal") * float(s))
    else:
        values, value = [], float(a)
        for _ in range(n + 2):  # a sum depends on all before it; bounded by ``most``
            values.append(value)
            value += float(s)
        grid = grid.join(F.broadcast(spark.createDataFrame(list(enumerate(values)), "ordinal INT, value DOUBLE")), "ordinal")
    kept = F.col("value") <= float(b) if inclusive else F.col("value") < float(b)
    out = (grid if semantics == "decimal_fixed_point" else grid.where(kept)).select("ordinal", decimal_text(F.col("exact")).alias("candidate_id"), "value")
    if n == 0:
        raise ValueError("the range holds no candidate")
    return out


def candidate_count(spark: SparkSession, start: str, step: str, count: int, semantics: str = "decimal_fixed_point") -> DataFrame:
    """(ordinal, candidate_id, value) of ``count`` candidates from start."""
    if not 0 < count <= MOST_CANDIDATES:
        raise ValueError(f"count is from 1 to {MOST_CANDIDATES}")
    stop = Decimal(start) + Decimal(step) * (count + 1)
    return candidate_range(spark, start, str(stop), step, True, semantics).where(F.col("ordinal") < count)


def profile_grid(spark: SparkSession, profile_id: str) -> DataFrame:
    p = profile(profile_id)
    return candidate_range(spark, p["start"], p["stop"], p["step"], True, p["semantics"])


def preset_grid(spark: SparkSession, preset: str, centre: str = "0", half_span: str = "5", semantics: str = "decimal_fixed_point") -> DataFrame:
    """``integer_coarse``: 500 to 1000 by 1; ``fractional_refine``: around a centre by 0.1."""
    if preset == "integer_coarse":
        return candidate_range(spark, "500", "1000", "1", True, semantics)
    if preset != "fractional_refine":
        raise ValueError(f"no preset {preset}")
    low, high = Decimal(centre) - Decimal(half_span), Decimal(centre) + Decimal(half_span)
    return candidate_range(spark, str(low), str(high), "0.1", True, semantics)


def bicubic_sweep(spark: SparkSession, bs: list[float], cs: list[float]) -> DataFrame:
    """(ordinal, kernel) of the cross product, b outer and c inner, without repeats (first wins)."""
    pairs = list(dict.fromkeys((float(b), float(c)) for b in bs for c in cs))
    rows = spark.createDataFrame([(k, b, c) for k, (b, c) in enumerate(pairs)], "ordinal INT, b DOUBLE, c DOUBLE")
    return rows.select("ordinal", F.struct(F.lit("bicubic").alias("id"), "b", "c", F.lit(None).cast("int").alias("taps")).alias("kernel"))


def lanczos_list(taps: str):
    """Distinct, positive, ascending taps of an array column."""
    return F.sort_array(F.array_distinct(F.filter(taps, lambda t: t >= 1)))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with the same key the first in order, renumbered: primary kernels before extra ones, first ids before repeats."""
    firsts = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(order).alias("_order"), F.struct(*rows.columns).alias("_row"))).alias("_first"))
    return firsts.select("_first._row.*")


def work_estimate(samples, kernels, candidates):
    """Units of work; a negative count is none."""
    clip = lambda x: F.greatest(F.lit(0), x)
    return clip(samples) * clip(kernels) * clip(candidates)


def height_defaults(spark: SparkSession) -> DataFrame:
    """What a new height draft starts with, for each profile: its grid, crop, threshold and kernel, both axes."""
    rows = profiles(spark)
    kind = F.when(F.col("step").cast("decimal(10,4)") == 1, "integer_coarse").otherwise("custom")
    return rows.select("profile_id", "start", "stop", "step", kind.alias("preset"), F.lit("h_plus_w").alias("axis_mode"), "crop", "threshold", "kernel_id", "b", "c", F.lit(1).alias("norm"))


def missing_base(preset, axis_mode, base_height, base_width):
    """The axis whose base a fractional refinement lacks, or null; the standard rule derives the width's from the height's."""
    fractional = preset == "fractional_refine"
    return F.when(fractional & axis_mode.isin("h_only", "h_plus_w") & base_height.isNull(), "height").when(fractional & (axis_mode == "w_only") & base_width.isNull(), "width")
