"""Grids, geometry, kernels and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, grids, kernels, numbers
from ..operators import metrics
from .common import rounded, table


def grid_of(semantics: str, inclusive: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grids.candidate_range(spark, "0.01", "0.19", "0.01", inclusive, semantics).select("ordinal", "candidate_id", rounded("value", 9))

    return query


def profile_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [grids.profile_grid(spark, p[0]).withColumn("profile_id", F.lit(p[0])) for p in grids.PROFILES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.sum("value"), 4).alias("total"))


def bicubic_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.bicubic_sweep(spark, [0, 0.2, 0.4, 0.2], [0, 0.25, 0.5]).select("ordinal", "kernel.b", "kernel.c")


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") / 2 - 12.5
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(numbers.half_even(x)).alias("half_even"), F.sum(numbers.toward_zero(x)).alias("truncated"), F.sum(numbers.grid_round(x)).alias("grid")
    )


SHAPE = "CAST(1920 AS DOUBLE) AS w, CAST(1080 AS DOUBLE) AS h, 300 + p_size * 11.375 + p_partkey % 100 AS v, 700 + p_partkey % 7 AS bh, 1000 + p_partkey % 5 AS bw"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(1920 AS BIGINT) AS w", "CAST(1080 AS BIGINT) AS h", "CAST(300 + p_size * 11.375 + p_partkey % 100 AS DOUBLE) AS v", "CAST(700 + p_partkey % 7 AS BIGINT) AS bh", "CAST(1000 + p_partkey % 5 AS BIGINT) AS bw")


def _flat(df: DataFrame, g) -> DataFrame:
    return df.withColumn("g", g).select("p_partkey", "g.width", "g.height", *(F.round(f"g.{c}", 6).alias(c) for c in ("src_left", "src_top", "src_width", "src_height")))


def geometry_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_cases(spark, sf_dir), geometry.candidate_geometry(F.col("w"), F.col("h"), F.lit("h_plus_w"), F.col("v"), F.col("bh"), F.lit(None).cast("long")))


def geometry_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_cases(spark, sf_dir), geometry.candidate_geometry(F.col("w"), F.col("h"), F.lit("h_plus_w"), F.col("v"), F.col("bh"), F.col("bw")))


def geometry_height_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_cases(spark, sf_dir), geometry.candidate_geometry(F.col("w"), F.col("h"), F.lit("h_only"), F.col("v"), F.lit(None).cast("long"), F.lit(None).cast("long")))


def geometry_for_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("long")
    return _flat(_cases(spark, sf_dir), geometry.geometry_for_source(F.lit(1280.0), F.col("v"), F.lit("h_plus_w"), F.lit(1440.0), F.lit(1080.0), F.col("bh"), none))


def geometry_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("p_partkey", geometry.least_base(F.col("v"), F.lit("even")).alias("even_base"), geometry.least_base(F.col("v"), F.lit("odd")).alias("odd_base"), geometry.primary_candidate(F.col("v"), F.lit(500.0), F.col("bh")).alias("candidate"))


_STD = "w * v / h"
_CANVAS = lambda base, active: f"({base} - 2 * CAST(trunc(({base} - {active}) / 2.0) AS BIGINT))"
_RND = lambda x: f"CAST(round_even({x}, 0) AS BIGINT)"


def _geometry_sql(aw: str, ah: str, bw: str | None, bh: str | None) -> str:
    width = _CANVAS(bw, aw) if bw else _RND(aw)
    height = _CANVAS(bh, ah) if bh else _RND(ah)
    left, src_w = (f"({width} - {aw}) / 2.0", aw) if bw else ("0.0", f"CAST({width} AS DOUBLE)")
    top, src_h = (f"({height} - {ah}) / 2.0", ah) if bh else ("0.0", f"CAST({height} AS DOUBLE)")
    return f"""SELECT p_partkey, {width} AS width, {height} AS height, round(CAST({left} AS DOUBLE), 6) AS src_left, round(CAST({top} AS DOUBLE), 6) AS src_top,
 round({src_w}, 6) AS src_width, round({src_h}, 6) AS src_height FROM (SELECT p_partkey, CAST(1920 AS DOUBLE) AS w, CAST(1080 AS DOUBLE) AS h,
 CAST(300 + p_size * 11.375 + p_partkey % 100 AS DOUBLE) AS v, CAST(700 + p_partkey % 7 AS BIGINT) AS bh, CAST(1000 + p_partkey % 5 AS BIGINT) AS bw FROM part)"""


_KERNELS = (("bilinear", None, None, None), ("bicubic", 1 / 3, 1 / 3, None), ("bicubic", 0.0, 0.5, None), ("lanczos", None, None, 3), ("spline16", None, None, None), ("spline36", None, None, None), ("spline64", None, None, None))


def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each kernel's weights over all lines' distances."""
    lines = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 25) / 6 + F.col("l_discount")).alias("x"))
    sums = lines.agg(*(F.round(F.sum(kernels.weight(kernels.kernel(*k), F.col("x"))), 4).alias(f"k{i}") for i, k in enumerate(_KERNELS)))
    return sums


def _kernel_sql() -> str:
    a, cube, square = "abs(x)", "pow({}, 3)", "pow({}, 2)"
    parts = [f"greatest(1 - {a}, 0)"]
    for b, c in ((1 / 3, 1 / 3), (0.0, 0.5)):
        b, c = f"CAST({b!r} AS DOUBLE)", f"CAST({c!r} AS DOUBLE)"
        parts.append(
            f"CASE WHEN {a} < 1 THEN ((12 - 9 * {b} - 6 * {c}) * {cube.format(a)} + (-18 + 12 * {b} + 6 * {c}) * {square.format(a)} + 6 - 2 * {b}) / 6"
            f" WHEN {a} < 2 THEN ((-{b} - 6 * {c}) * {cube.format(a)} + (6 * {b} + 30 * {c}) * {square.format(a)} + (-12 * {b} - 48 * {c}) * {a} + 8 * {b} + 24 * {c}) / 6 ELSE 0 END"
        )
    sinc = lambda v: f"CASE WHEN {v} = 0 THEN 1 ELSE sin(pi() * {v}) / (pi() * {v}) END"
    parts.append(f"CASE WHEN {a} < 3 THEN ({sinc(a)}) * ({sinc(f'({a} / 3)')}) ELSE 0 END")
    for denominator, units in kernels.SPLINES.values():
        whens = [f"WHEN {a} < {u + 1} THEN ({p[0]} + {p[1]} * ({a} - {u}) + {p[2]} * {square.format(f'({a} - {u})')} + {p[3]} * {cube.format(f'({a} - {u})')}) / {denominator}.0" for u, p in enumerate(units)]
        parts.append(f"CASE {' '.join(whens)} ELSE 0 END")
    sums = ", ".join(f"round(sum(CAST({p} AS DOUBLE)), 4) AS k{i}" for i, p in enumerate(parts))
    return f"SELECT {sums} FROM (SELECT (l_quantity - 25) / 6 + l_discount AS x FROM lineitem)"


def kernel_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *k) for i, k in enumerate((*_KERNELS, ("lanczos", None, None, 16), ("bicubic", None, 0.5, None), ("gauss", None, None, None)))]
    df = spark.createDataFrame(rows, "ordinal INT, id STRING, b DOUBLE, c DOUBLE, taps INT").withColumn("k", F.struct("id", "b", "c", "taps"))
    return df.select("ordinal", kernels.support(F.col("k")).alias("support"), kernels.problem(F.col("k")).alias("problem"), kernels.signature(F.col("k")).alias("signature"), kernels.family_rank(F.col("id")).alias("family"))


def border_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("p_partkey") % 60 - 20 + 0.5).alias("centre")
    rows = table(spark, sf_dir, "part").select("p_partkey", c)
    return rows.select("p_partkey", *(kernels.border(F.col("centre"), F.lit(24), m).cast("long").alias(m) for m in ("zero", "repeat", "mirror")))


def _pnorm(norm: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") * 5 - F.col("l_tax") * 3).alias("d"))
        return rows.groupBy("l_suppkey").agg(F.round(metrics.p_norm_agg(F.col("d"), 0.1, norm), 5).alias("error"))

    return query


def pnorm_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") * 5 - F.col("l_tax") * 3).alias("d"))
    return metrics.p_norm_scaled(rows, "l_suppkey", "d", 0.1, 256).select("l_suppkey", rounded("error", 5))


_D = "SELECT l_suppkey, abs(CAST(l_discount * 5 - l_tax * 3 AS FLOAT)) AS d FROM lineitem"


def cropped_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean kept difference of 64-pixel lines against 0 within a crop; a line's vector is its pixels."""
    crop = F.struct(F.lit(5).alias("crop_left"), F.lit(7).alias("crop_right"), F.lit(2).alias("crop_top"), F.lit(3).alias("crop_bottom"))
    lines = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 50).alias("y"), F.posexplode("embedding").alias("x", "v"))
    inside = lines.where(metrics.cropped(F.lit(64), F.lit(50), F.col("x"), F.col("y"), crop))
    return inside.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.p_norm_agg(F.col("v"), 0.05, 1), 6).alias("error"))


def metric_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.problem([F.col("p_size") - 3], F.col("p_retailprice") - 950, F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select(F.coalesce(p, F.lit("none")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    w, h = numbers.bounded_size(F.col("event_id") % 3000 + 1, F.col("user_id") + 100, 640)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(numbers.nice_step(v), 6).alias("nice"),
        F.round(numbers.display_log(v), 6).alias("shown"),
        F.round(numbers.floored_log(v - 100), 6).alias("floored"),
        F.round(numbers.seconds_of_ticks(F.col("event_id"), F.lit(1001), F.lit(24000)), 6).alias("seconds"),
        F.round(numbers.luma(v, v / 2, v / 4), 9).alias("luma"),
        F.round(numbers.code_to_luma(F.col("event_id") % 1024, F.lit(10)).cast("double"), 5).alias("code"),
        w.alias("w"),
        h.alias("h"),
        numbers.same_value(v.cast("string"), F.format_string("%.2f", v)).alias("same"),
    )


def work_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", grids.work_estimate(F.col("s_suppkey") % 5, F.col("s_nationkey").cast("long"), F.floor(F.col("s_acctbal"))).alias("work"))


QUERIES = {
    "grid_decimal": grid_of("decimal_fixed_point"),
    "grid_decimal_exclusive": grid_of("decimal_fixed_point", False),
    "grid_index": grid_of("index_multiplication"),
    "grid_repeated": grid_of("repeated_addition"),
    "profile_grids": profile_grids,
    "bicubic_sweep": bicubic_sweep,
    "rounding": rounding,
    "geometry_standard": geometry_standard,
    "geometry_independent": geometry_independent,
    "geometry_height_only": geometry_height_only,
    "geometry_for_source": geometry_for_source,
    "geometry_bases": geometry_bases,
    "kernel_weights": kernel_weights,
    "kernel_catalogue": kernel_catalogue,
    "border_mapping": border_mapping,
    "pnorm_p1": _pnorm(1),
    "pnorm_p2": _pnorm(2),
    "pnorm_p3": _pnorm(3),
    "pnorm_p4": _pnorm(4),
    "pnorm_high": pnorm_high,
    "cropped_pixels": cropped_pixels,
    "metric_problems": metric_problems,
    "scalar_math": scalar_math,
    "work_estimates": work_estimates,
}

_GRID = "SELECT CAST(i AS INTEGER) AS ordinal, regexp_replace(CAST(CAST((1 + i) * 0.01 AS DECIMAL(10,2)) AS VARCHAR), '\\.?0+$', '') AS candidate_id, round({value}, 9) AS value FROM range({n}) t(i)"
ORACLES = {
    "grid_decimal": _GRID.format(value="CAST(CAST((1 + i) * 0.01 AS DECIMAL(10,2)) AS DOUBLE)", n=19),
    "grid_decimal_exclusive": _GRID.format(value="CAST(CAST((1 + i) * 0.01 AS DECIMAL(10,2)) AS DOUBLE)", n=18),
    "grid_index": _GRID.format(value="CAST(0.01 AS DOUBLE) + i * CAST(0.01 AS DOUBLE)", n=20) + " WHERE CAST(0.01 AS DOUBLE) + i * CAST(0.01 AS DOUBLE) <= CAST(0.19 AS DOUBLE)",
    "grid_repeated": """WITH RECURSIVE g(i, v) AS (SELECT 0, CAST(0.01 AS DOUBLE) UNION ALL SELECT i + 1, v + CAST(0.01 AS DOUBLE) FROM g WHERE i < 25)
 SELECT CAST(i AS INTEGER) AS ordinal, regexp_replace(CAST(CAST((1 + i) * 0.01 AS DECIMAL(10,2)) AS VARCHAR), '\\.?0+$', '') AS candidate_id, round(v, 9) AS value FROM g WHERE v <= CAST(0.19 AS DOUBLE)""",
    "profile_grids": """SELECT p AS profile_id, count(*) AS n, min(v) AS low, max(v) AS high, round(sum(v), 4) AS total FROM (
 SELECT 'accumulated' AS p, 500.0::DOUBLE + i AS v FROM range(501) t(i) UNION ALL SELECT 'indexed', 500.0::DOUBLE + i * 0.25::DOUBLE FROM range(2001) t(i) UNION ALL SELECT 'exact', 500.0::DOUBLE + i FROM range(501) t(i)) GROUP BY p""",
    "bicubic_sweep": "SELECT CAST(row_number() OVER (ORDER BY b, c) - 1 AS INTEGER) AS ordinal, b, c FROM (SELECT unnest([0, 0.2, 0.4])::DOUBLE AS b), (SELECT unnest([0, 0.25, 0.5])::DOUBLE AS c)",
    "rounding": """SELECT l_returnflag, CAST(sum(round_even(x, 0)) AS BIGINT) AS half_even, CAST(sum(trunc(x)) AS BIGINT) AS truncated,
 CAST(sum(CASE WHEN x < 0 THEN floor(x + 0.5) ELSE floor(x + 0.49999999999999994::DOUBLE) END) AS BIGINT) AS grid FROM (SELECT l_returnflag, l_quantity / 2 - 12.5::DOUBLE AS x FROM lineitem) GROUP BY l_returnflag""",
    "geometry_standard": _geometry_sql(f"({_STD})", "v", _RND("w / h * bh"), "bh"),
    "geometry_independent": _geometry_sql(f"({_STD})", "v", "bw", "bh"),
    "geometry_height_only": _geometry_sql("w", "v", None, None),
    "geometry_for_source": _geometry_sql("(1440.0::DOUBLE * v / 1080.0::DOUBLE)", "v", None, "bh"),
    "geometry_bases": """SELECT p_partkey, CAST(ceil(v) + CASE WHEN ceil(v) % 2 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS even_base, CAST(ceil(v) + CASE WHEN ceil(v) % 2 <> 1 THEN 1 ELSE 0 END AS BIGINT) AS odd_base,
 CASE WHEN v > 500 THEN CAST(bh AS DOUBLE) ELSE v END AS candidate FROM (SELECT p_partkey, CAST(300 + p_size * 11.375 + p_partkey % 100 AS DOUBLE) AS v, 700 + p_partkey % 7 AS bh FROM part)""",
    "kernel_weights": _kernel_sql(),
    "kernel_catalogue": """SELECT CAST(o AS INTEGER) AS ordinal, CAST(s AS INTEGER) AS support, p AS problem, g AS signature, CAST(f AS BIGINT) AS family FROM (VALUES
 (0, 1, NULL, 'bilinear', 0), (1, 2, NULL, 'bicubic|0.333333333|0.333333333', 1), (2, 2, NULL, 'bicubic|0|0.5', 1), (3, 3, NULL, 'lanczos|3', 2), (4, 2, NULL, 'spline16', 3), (5, 3, NULL, 'spline36', 4),
 (6, 4, NULL, 'spline64', 5), (7, NULL, 'lanczos_taps_out_of_range', 'lanczos|16', 2), (8, 2, 'bicubic_needs_b_and_c', 'bicubic|0.5', 1), (9, NULL, 'unknown_kernel', 'gauss', -1)) t(o, s, p, g, f)""",
    "border_mapping": """SELECT p_partkey, CAST(CASE WHEN c >= 0 AND c < 24 THEN floor(c) END AS BIGINT) AS zero, CAST(greatest(0, least(floor(c), 23)) AS BIGINT) AS repeat,
 CAST(floor(CASE WHEN c < 0 THEN -c WHEN c >= 24 THEN least(48 - c, 23.5) ELSE c END) AS BIGINT) AS mirror FROM (SELECT p_partkey, CAST(p_partkey % 60 - 20 + 0.5 AS DOUBLE) AS c FROM part)""",
    **{
        f"pnorm_p{p}": f"SELECT l_suppkey, round(pow(sum(CASE WHEN d > CAST(0.1 AS FLOAT) THEN pow(CAST(d AS DOUBLE), {p}) ELSE 0 END) / count(*), 1.0 / {p}), 5) AS error FROM ({_D}) GROUP BY l_suppkey"
        for p in (1, 2, 3, 4)
    },
    "pnorm_high": f"""SELECT a.l_suppkey, round(CASE WHEN m IS NULL THEN 0 ELSE m * pow(sum(CASE WHEN d > CAST(0.1 AS FLOAT) THEN pow(CAST(d AS DOUBLE) / m, 256) ELSE 0 END) / count(*), 1.0 / 256) END, 5) AS error
 FROM ({_D}) a JOIN (SELECT l_suppkey, CAST(max(CASE WHEN d > CAST(0.1 AS FLOAT) THEN d END) AS DOUBLE) AS m FROM ({_D}) GROUP BY l_suppkey) b USING (l_suppkey) GROUP BY a.l_suppkey, m""",
    "cropped_pixels": """SELECT label, count(*) AS n, round(sum(CASE WHEN d > CAST(0.05 AS FLOAT) THEN CAST(d AS DOUBLE) ELSE 0 END) / count(*), 6) AS error FROM (
 SELECT label, vec_id % 50 AS y, unnest(range(64)) AS x, abs(unnest(embedding)) AS d FROM embeddings) WHERE x >= 5 AND x < 57 AND y >= 2 AND y < 47 GROUP BY label""",
    "metric_problems": """SELECT CASE WHEN p_size - 3 < 0 THEN 'crop_negative' WHEN p_retailprice - 950 < 0 THEN 'threshold_negative' WHEN p_partkey % 4 < 1 THEN 'norm_out_of_range' ELSE 'none' END AS problem, count(*) AS n FROM part GROUP BY 1""",
    "scalar_math": """SELECT event_id, round(CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 2.5 THEN 2.5 WHEN f <= 5 THEN 5 ELSE 10 END * m, 6) AS nice, round(log10(value + 1e-9), 6) AS shown, round(log10(greatest(value - 100, 1e-12)), 6) AS floored,
 round(event_id * 1001.0 / 24000.0, 6) AS seconds, round(0.2126 * value + 0.7152 * (value / 2) + 0.0722 * (value / 4), 9) AS luma, round(CAST(CAST((event_id % 1024) * 64.0 / 65535.0 AS FLOAT) AS DOUBLE), 5) AS code,
 CAST(greatest(1, floor(pw * least(1.0, 640 / CAST(greatest(pw, ph) AS DOUBLE)) + 0.5)) AS BIGINT) AS w, CAST(greatest(1, floor(ph * least(1.0, 640 / CAST(greatest(pw, ph) AS DOUBLE)) + 0.5)) AS BIGINT) AS h,
 abs(value - CAST(printf('%.2f', value) AS DOUBLE)) <= 1e-6 * greatest(1, value) AS same
 FROM (SELECT *, pow(10.0, floor(log10(value))) AS m, value / pow(10.0, floor(log10(value))) AS f, event_id % 3000 + 1 AS pw, user_id + 100 AS ph FROM events)""",
    "work_estimates": "SELECT s_suppkey, CAST(greatest(0, s_suppkey % 5) * greatest(0, s_nationkey) * greatest(0, floor(s_acctbal)) AS BIGINT) AS work FROM supplier",
}
