"""From a candidate value to the canvas and the source rectangle that it stands for.

A geometry is a struct (width, height, src_left, src_top, src_width, src_height). Wrong input gives
a null struct; ``geometry_problem`` says why.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_even, toward_zero

AXIS_MODES = ("h_only", "w_only", "h_plus_w")


def parity_canvas(base: Column, active: Column) -> Column:
    """The canvas of the base's parity that is nearest to the active length, from the base's side."""
    return base - 2 * toward_zero((base - active) / 2.0)


def _struct(width: Column, height: Column, left: Column, top: Column, src_width: Column, src_height: Column) -> Column:
    return F.struct(
        width.cast("long").alias("width"),
        height.cast("long").alias("height"),
        left.cast("double").alias("src_left"),
        top.cast("double").alias("src_top"),
        src_width.cast("double").alias("src_width"),
        src_height.cast("double").alias("src_height"),
    )


def _axis(active: Column, base: Column) -> tuple[Column, Column, Column]:
    """(canvas, offset, source length) of one axis on its own; without a base all is whole."""
    whole = half_even(active)
    canvas = F.when(base.isNull(), whole).otherwise(parity_canvas(base, active))
    return canvas, F.when(base.isNull(), 0.0).otherwise((canvas - active) / 2.0), F.when(base.isNull(), whole.cast("double")).otherwise(active)


def _positive(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(v > 0, F.lit(False)) & ~F.isnan(v.cast("double")) & (v.cast("double") < float("inf"))
    return out


def independent_geometry(active_width: Column, active_height: Column, base_height: Column, base_width: Column) -> Column:
    """Each axis with its own base, or none."""
    w, left, src_w = _axis(active_width, base_width)
    h, top, src_h = _axis(active_height, base_height)
    bases = (base_height.isNull() | (base_height > 0)) & (base_width.isNull() | (base_width > 0))
    return F.when(_positive(active_width, active_height) & bases & (w > 0) & (h > 0), _struct(w, h, left, top, src_w, src_h))


def standard_geometry(source_width: Column, source_height: Column, active_width: Column, active_height: Column, base_height: Column) -> Column:
    """The base's width follows from its height and the source's shape."""
    base_width = F.when(base_height.isNotNull(), half_even(source_width.cast("double") / source_height.cast("double") * base_height.cast("double")))
    return F.when(_positive(source_width, source_height), independent_geometry(active_width, active_height, base_height, base_width))


def active_lengths(source_width: Column, source_height: Column, axis_mode: Column, candidate: Column) -> tuple[Column, Column]:
    """(width, height) that a candidate stands for: the scanned axis takes it, both keep the source's shape."""
    width = F.when(axis_mode == "w_only", candidate).when(axis_mode == "h_plus_w", source_width.cast("double") * candidate / source_height.cast("double")).otherwise(source_width.cast("double"))
    return width, F.when(axis_mode == "w_only", source_height.cast("double")).otherwise(candidate)


def candidate_geometry(source_width: Column, source_height: Column, axis_mode: Column, candidate: Column, base_height: Column, base_width: Column) -> Column:
    """Both axes without a base width follow the standard rule, all else the independent one."""
    width, height = active_lengths(source_width, source_height, axis_mode, candidate)
    standard = standard_geometry(source_width, source_height, width, height, base_height)
    independent = independent_geometry(width, height, base_height, base_width)
    known = axis_mode.isin(*AXIS_MODES) & _positive(source_width, source_height, candidate)
    return F.when(known & (axis_mode == "h_plus_w") & base_width.isNull(), standard).when(known, independent)


def plain_geometry(active_width: Column, active_height: Column) -> Column:
    """Without a profile: canvases are the truncated lengths."""
    return _struct(toward_zero(active_width), toward_zero(active_height), F.lit(0.0), F.lit(0.0), active_width, active_height)


def geometry_for_source(src_width: Column, src_height: Column, axis_mode: Column, source_width: Column, source_height: Column, base_height: Column, base_width: Column) -> Column:
    """A chosen geometry for a source of another shape: the axis that isn't scanned follows the source."""
    width = F.when(axis_mode == "h_only", source_width.cast("double")).when(axis_mode == "w_only", src_width).otherwise(source_width * src_height / source_height)
    height = F.when(axis_mode == "w_only", source_height.cast("double")).otherwise(src_height)
    return independent_geometry(width, height, base_height, base_width)


def least_base(src: Column, parity: Column) -> Column:
    """The smallest integer of that parity no less than ``src``; null where integers of either will do."""
    up = F.ceil(src)
    return F.when(parity.isin("even", "odd"), up + F.when(F.pmod(up, F.lit(2)) != F.when(parity == "odd", 1).otherwise(0), 1).otherwise(0))


def primary_candidate(src: Column, canvas: Column, base: Column) -> Column:
    """The scanned value of a geometry; old ones kept it in the base, and their source exceeds the canvas."""
    return F.when((src > canvas) & base.isNotNull(), base.cast("double")).otherwise(src)


def scan_selection(axis_mode: Column, selected: Column, source_width: Column, source_height: Column, own_width: Column, own_height: Column) -> Column:
    """(src_width, src_height) of a selected candidate."""
    width, height = active_lengths(source_width, source_height, axis_mode, selected)
    both = axis_mode == "h_plus_w"
    return F.struct(F.when(both, F.coalesce(own_width, width)).otherwise(width).alias("src_width"), F.when(both, F.coalesce(own_height, height)).otherwise(height).alias("src_height"))


def geometry_problem(geometry: str) -> Column:
    """The first rule that a geometry column breaks, or null."""
    g = lambda name: F.col(f"{geometry}.{name}")
    numbers = [g(n) for n in ("src_left", "src_top", "src_width", "src_height")]
    finite = F.lit(True)
    for x in numbers:
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        F.when(F.col(geometry).isNull(), "geometry_missing")
        .when((g("width") <= 0) | (g("height") <= 0), "canvas_not_positive")
        .when(~finite, "not_finite")
        .when((g("src_width") <= 0) | (g("src_height") <= 0), "source_not_positive")
        .when((g("src_left") < 0) | (g("src_top") < 0) | (g("src_left") + g("src_width") > g("width") + 1e-9) | (g("src_top") + g("src_height") > g("height") + 1e-9), "outside_canvas")
    )


def migrated_geometry(old: str) -> Column:
    """An old snapshot's struct in today's names; ``needs_review`` where the source exceeds its canvas, so that it can't be told what was meant."""
    c = lambda *names: F.coalesce(*(F.col(f"{old}.{n}") for n in names))
    width, height, src_w, src_h = c("canvas_width"), c("canvas_height"), c("src_width", "active_width"), c("src_height", "active_height")
    return F.struct(
        width.alias("canvas_width"),
        height.alias("canvas_height"),
        src_w.alias("src_width"),
        src_h.alias("src_height"),
        F.coalesce(c("src_left"), (width - src_w) / 2).alias("src_left"),
        F.coalesce(c("src_top"), (height - src_h) / 2).alias("src_top"),
        F.coalesce((src_w > width) | (src_h > height), F.lit(True)).alias("needs_review"),
    )
