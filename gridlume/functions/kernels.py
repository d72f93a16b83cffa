"""Resampling kernels as column expressions over (id, b, c, taps) and a distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import decimal_text

#: Families in canonical order.
FAMILIES = ("bilinear", "bicubic", "lanczos", "spline16", "spline36", "spline64")
#: For each unit of distance of a spline, the denominator and the coefficients of 1, t, t^2 and t^3 from its start.
SPLINES = {
    "spline16": (15, ((15, -3, -27, 15), (0, -7, 12, -5))),
    "spline36": (209, ((209, -3, -453, 247), (0, -156, 270, -114), (0, 26, -45, 19))),
    "spline64": (2911, ((2911, -3, -6387, 3479), (0, -2328, 4032, -1704), (0, 582, -1008, 426), (0, -97, 168, -71))),
}
MOST_TAPS = 15
KERNEL_DDL = "id STRING, b DOUBLE, c DOUBLE, taps INT"


def kernel(id: str, b: float | None = None, c: float | None = None, taps: int | None = None) -> Column:
    return F.struct(F.lit(id).alias("id"), F.lit(b).cast("double").alias("b"), F.lit(c).cast("double").alias("c"), F.lit(taps).cast("int").alias("taps"))


def support(k: Column) -> Column:
    """Reach of a kernel; null for an unknown one or taps out of range."""
    out = F.when(k["id"] == "bilinear", 1).when(k["id"] == "bicubic", 2).when((k["id"] == "lanczos") & k["taps"].between(1, MOST_TAPS), k["taps"])
    for name, (_, parts) in SPLINES.items():
        out = out.when(k["id"] == name, len(parts))
    return out.cast("int")


def _polynomial(t: Column, coefficients: tuple[Column | float, ...]) -> Column:
    out = F.lit(coefficients[-1]) if not isinstance(coefficients[-1], Column) else coefficients[-1]
    for a in reversed(coefficients[:-1]):
        out = out * t + a
    return out


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / F.nullif(math.pi * x, F.lit(0.0)))


def weight(k: Column, distance: Column) -> Column:
    """The kernel's weight at a distance; 0 beyond its support."""
    x, b, c = F.abs(distance.cast("double")), k["b"], k["c"]
    near = _polynomial(x, (6 - 2 * b, F.lit(0.0), -18 + 12 * b + 6 * c, 12 - 9 * b - 6 * c)) / 6
    far = _polynomial(x, (8 * b + 24 * c, -12 * b - 48 * c, 6 * b + 30 * c, -b - 6 * c)) / 6
    out = (
        F.when(k["id"] == "bilinear", F.greatest(1 - x, F.lit(0.0)))
        .when(k["id"] == "bicubic", F.when(x < 1, near).when(x < 2, far).otherwise(0.0))
        .when(k["id"] == "lanczos", F.when(x < k["taps"], _sinc(x) * _sinc(x / k["taps"])).otherwise(0.0))
    )
    for name, (denominator, parts) in SPLINES.items():
        spline = F.lit(0.0)
        for unit in reversed(range(len(parts))):
            spline = F.when(x < unit + 1, _polynomial(x - unit, tuple(float(a) for a in parts[unit])) / denominator).otherwise(spline)
        out = out.when(k["id"] == name, spline)
    return out


def border(centre: Column, size: Column, mode: str) -> Column:
    """The pixel that a tap's centre falls on; outside, null for ``zero``, the edge for ``repeat``, the reflection for ``mirror``."""
    inside = (centre >= 0) & (centre < size)
    if mode == "zero":
        return F.when(inside, F.floor(centre))
    if mode == "repeat":
        return F.greatest(F.lit(0), F.least(F.floor(centre), size - 1))
    if mode != "mirror":
        raise ValueError(f"no border mode {mode}")
    folded = F.when(centre < 0, -centre).when(centre >= size, F.least(2 * size - centre, size - 0.5)).otherwise(centre)
    return F.floor(folded)


def problem(k: Column) -> Column:
    """Why a kernel can't be used, or null."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return (
        F.when(k["id"].isNull() | ~k["id"].isin(*FAMILIES), "unknown_kernel")
        .when((k["id"] == "bicubic") & ~(finite(k["b"]) & finite(k["c"])), "bicubic_needs_b_and_c")
        .when((k["id"] == "lanczos") & F.coalesce(~k["taps"].between(1, MOST_TAPS), F.lit(True)), "lanczos_taps_out_of_range")
    )


def wire(k: Column) -> Column:
    """Only the parameters that matter to the family."""
    return F.struct(
        k["id"].alias("id"),
        F.when(k["id"] == "bicubic", k["b"]).alias("b"),
        F.when(k["id"] == "bicubic", k["c"]).alias("c"),
        F.when(k["id"] == "lanczos", k["taps"]).alias("taps"),
    )


def echo(k: Column) -> Column:
    """JSON of the kernel with defaults filled in: b 0, c 0.5, taps 3."""
    return F.to_json(
        F.struct(
            k["id"].alias("id"),
            F.when(k["id"] == "bicubic", F.coalesce(k["b"], F.lit(0.0))).alias("b"),
            F.when(k["id"] == "bicubic", F.coalesce(k["c"], F.lit(0.5))).alias("c"),
            F.when(k["id"] == "lanczos", F.coalesce(k["taps"], F.lit(3))).alias("taps"),
        )
    )


def _number(x: Column) -> Column:
    return decimal_text(x.cast("decimal(20,9)"))


def signature(k: Column) -> Column:
    """Equal for kernels that weigh alike: the family and the parameters that matter."""
    return F.concat_ws("|", k["id"], F.when(k["id"] == "bicubic", _number(k["b"])), F.when(k["id"] == "bicubic", _number(k["c"])), F.when(k["id"] == "lanczos", k["taps"].cast("string")))


def label(k: Column) -> Column:
    parameters = F.concat_ws(",", F.when(k["id"] == "bicubic", F.concat(F.lit("b="), _number(k["b"]))), F.when(k["id"] == "bicubic", F.concat(F.lit("c="), _number(k["c"]))), F.when(k["id"] == "lanczos", F.concat(F.lit("taps="), k["taps"])))
    return F.when(parameters == "", k["id"]).otherwise(F.concat(k["id"], F.lit("("), parameters, F.lit(")")))


def family_rank(id: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(f) for f in FAMILIES)), id).cast("long"), F.lit(0)) - 1
