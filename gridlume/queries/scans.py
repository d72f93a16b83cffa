"""Scans, verification and plans over frames of 64-wide lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, grids, kernels
from ..operators import scans
from ..plans import store
from .common import rounded, table
from .scan_sql import scan

LINES = 96  #: of a frame; the last frame may have fewer
METRIC = {"crop": (5, 5, 5, 5), "threshold": 0.0, "norm": 1}


def image_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive vectors are the lines of frames."""
    lines = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / LINES).alias("frame_id"), "vec_id", "embedding")
    stacked = lines.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("l"))
    return stacked.select("frame_id", F.lit(64).alias("width"), F.size("l").alias("height"), F.flatten(F.transform("l", lambda x: x["embedding"])).alias("pixels"))


def _found(rows: DataFrame, *columns: str) -> DataFrame:
    """Errors to 4 places: plans hold 32-bit numbers. The SQL has one name for a candidate without an error, also where the crop takes all of a frame."""
    problem = F.when(F.col("problem") == "crop_leaves_no_pixel", "destination_out_of_range").otherwise(F.coalesce("problem", F.lit("none")))
    return rows.select("frame_id", *columns, rounded("error", 4), problem.alias("problem"))


def height_scan_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native heights 40 to 60 of every frame, without a profile."""
    grid = grids.candidate_range(spark, "40", "60", "5")
    found = scans.height_scan(image_frames(spark, sf_dir), grid, kernels.kernel("bilinear"), "h_only", METRIC, profiled=False)
    return found.select("frame_id", "candidate_id", rounded("error", 4), F.coalesce("problem", F.lit("none")).alias("problem"))


def height_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both axes, fractional candidates with a base, bicubic."""
    grid = grids.candidate_range(spark, "40", "60", "0.5", semantics="index_multiplication")
    return _found(scans.height_scan(image_frames(spark, sf_dir), grid, kernels.kernel("bicubic", 0.0, 0.5), "h_plus_w", METRIC, base_height=61), "ordinal", "value")


def width_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(scans.height_scan(image_frames(spark, sf_dir), grids.candidate_range(spark, "30", "60", "1"), kernels.kernel("lanczos", taps=3), "w_only", METRIC), "ordinal", "value")


def kernel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bicubic sweep and all other families at one geometry."""
    sweep = grids.bicubic_sweep(spark, [0, 0.2, 0.4, 0.6, 0.8, 1], [0, 0.2, 0.4, 0.6, 0.8, 1])
    rest = [("bilinear", None), ("lanczos", 3), ("lanczos", 4), ("spline16", None), ("spline36", None), ("spline64", None)]
    more = spark.createDataFrame([(36 + k, i, t) for k, (i, t) in enumerate(rest)], "ordinal INT, id STRING, taps INT").select("ordinal", F.struct("id", F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c"), "taps").alias("kernel"))
    shape = geometry.independent_geometry(F.lit(48.0), F.lit(64.0), F.lit(None).cast("long"), F.lit(None).cast("long"))
    found = scans.kernel_scan(image_frames(spark, sf_dir), sweep.unionByName(more), shape, "h_plus_w", METRIC)
    return _found(found.withColumn("id", F.col("kernel.id")), "ordinal", "id")


def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = geometry.independent_geometry(F.lit(48.0), F.lit(64.0), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return _found(scans.verify(image_frames(spark, sf_dir), shape, kernels.kernel("bicubic", 0.0, 0.5), "h_plus_w", METRIC))


def _media_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a media file, shown in the reverse of their decoding order."""
    rows = image_frames(spark, sf_dir).where(F.col("height") == LINES)
    return rows.select("frame_id", F.col("frame_id").alias("decode_index"), (-F.col("frame_id")).alias("pts"), F.lit(None).cast("long").alias("best_effort"), F.col("frame_id").alias("dts"), "width", "height", "pixels")


def media_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second frame by presentation."""
    shape = geometry.independent_geometry(F.lit(48.0), F.lit(64.0), F.lit(None).cast("long"), F.lit(None).cast("long"))
    found, _ = scans.verify_media(_media_frames(spark, sf_dir), F.col("frame_index") % 2 == 0, shape, kernels.kernel("bicubic", 0.0, 0.5), "h_plus_w", METRIC)
    return found.select("frame_id", "frame_index", rounded("error", 4))


def plan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of parts' sizes as native heights of 96 lines, once each."""
    k = F.struct(F.lit("spline36").alias("id"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("int").alias("taps"))
    shape = geometry.plain_geometry(F.lit(64.0), (F.col("p_size") + 40).cast("double"))
    asked = table(spark, sf_dir, "part").select(shape.alias("geometry"), k.alias("kernel")).withColumns(store.axis_requests("geometry", "kernel", F.lit(96), False))
    return store.attach_plans(asked.select(*store.KEY), store.build_plans(asked)).groupBy("destination_size").agg(F.count(F.lit(1)).alias("requests"), F.max("half_bandwidth").alias("half_bandwidth"), F.coalesce(F.max("problem"), F.lit("none")).alias("problem"))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.capabilities(spark)


QUERIES = {f.__name__: f for f in (height_scan_bilinear, height_scan, width_scan, kernel_scan, verification, media_verification, plan_table, capabilities)}

_PROBLEM = "CASE WHEN error IS NULL THEN 'destination_out_of_range' ELSE 'none' END AS problem"
_CUBIC = "'bicubic' AS id, 0.0::DOUBLE AS b, 0.5::DOUBLE AS cc, NULL::INTEGER AS taps"
_FIXED = "48 AS nw, 48.0 AS aw, 0.0 AS lw, 64 AS nh, 64.0 AS ah, 0.0 AS th"
_BASED = "SELECT *, bw - 2 * trunc((bw - aw) / 2) AS nw0, 61 - 2 * trunc((61 - ah) / 2) AS nh0 FROM (SELECT f, w, h, i AS c, 40 + i * 0.5::DOUBLE AS ah, w * (40 + i * 0.5::DOUBLE) / h AS aw, round_even(w / h::DOUBLE * 61, 0) AS bw FROM fr, range(41) r(i))"
_SWEEP = "SELECT p * 6 + q AS c, 'bicubic' AS id, p / 5::DOUBLE AS b, q / 5::DOUBLE AS cc, NULL::INTEGER AS taps FROM range(6) a(p), range(6) b(q) UNION ALL SELECT * FROM (VALUES (36, 'bilinear', NULL, NULL, NULL), (37, 'lanczos', NULL, NULL, 3), (38, 'lanczos', NULL, NULL, 4), (39, 'spline16', NULL, NULL, NULL), (40, 'spline36', NULL, NULL, NULL), (41, 'spline64', NULL, NULL, NULL)) v"
ORACLES = {
    "height_scan": scan(f"SELECT f, w, h, c, {_CUBIC}, nw0::INTEGER AS nw, aw, (nw0 - aw) / 2 AS lw, nh0::INTEGER AS nh, ah, (nh0 - ah) / 2 AS th FROM ({_BASED})", 2, "hw", LINES, 5, f"SELECT f AS frame_id, c::INTEGER AS ordinal, ah AS value, round(error, 4) AS error, {_PROBLEM} FROM found"),
    "width_scan": scan("SELECT f, w, h, n - 30 AS c, 'lanczos' AS id, NULL::DOUBLE AS b, NULL::DOUBLE AS cc, 3 AS taps, n AS nw, n::DOUBLE AS aw, 0.0 AS lw, h AS nh, h::DOUBLE AS ah, 0.0 AS th FROM fr, range(30, 61) r(n)", 3, "w", LINES, 5, f"SELECT f AS frame_id, c::INTEGER AS ordinal, aw AS value, round(error, 4) AS error, {_PROBLEM} FROM found"),
    "kernel_scan": scan(f"SELECT f, w, h, c, id, b, cc, taps, {_FIXED} FROM fr, ({_SWEEP})", 4, "hw", LINES, 5, f"SELECT f AS frame_id, c::INTEGER AS ordinal, id, round(error, 4) AS error, {_PROBLEM} FROM found"),
    "media_verification": scan(f"SELECT f, w, h, 0 AS c, {_CUBIC}, {_FIXED} FROM fr WHERE h = {LINES}", 2, "hw", LINES, 5, "SELECT f AS frame_id, frame_index, round(error, 4) AS error FROM (SELECT *, row_number() OVER (ORDER BY -f) - 1 AS frame_index FROM found) WHERE frame_index % 2 = 0"),
    "verification": scan(f"SELECT f, w, h, 0 AS c, {_CUBIC}, {_FIXED} FROM fr", 2, "hw", LINES, 5, f"SELECT f AS frame_id, round(error, 4) AS error, {_PROBLEM} FROM found"),
    "height_scan_bilinear": f"""WITH RECURSIVE px AS (SELECT vec_id // {LINES} AS f, vec_id % {LINES} AS i, unnest(range(64)) AS x, CAST(unnest(embedding) AS DOUBLE) AS b FROM embeddings),
 fr AS (SELECT vec_id // {LINES} AS f, count(*) AS s FROM embeddings GROUP BY 1), cand AS (SELECT f, s, c AS n FROM fr, (SELECT unnest([40, 45, 50, 55, 60]) AS c)), ok AS (SELECT * FROM cand WHERE n < s),
 tap AS (SELECT f, n, s, i, t, p, CASE WHEN p - 1 < 0 THEN floor(p - 1 + 0.5) ELSE floor(p - 1 + 0.49999999999999994::DOUBLE) END + 0.5 + t AS ctr FROM (SELECT ok.*, r.i, u.t, (r.i + 0.5::DOUBLE) / (s / CAST(n AS DOUBLE)) AS p FROM ok, range(s) r(i), range(2) u(t))),
 raw AS (SELECT f, n, s, i, floor(CASE WHEN ctr < 0 THEN -ctr WHEN ctr >= n THEN least(2 * n - ctr, n - 0.5) ELSE ctr END)::INTEGER AS j, greatest(1 - abs(ctr - p), 0) AS w FROM tap),
 a AS (SELECT f, n, s, i, j, sum(w) / any_value(tot) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY f, n, i) AS tot FROM raw) GROUP BY f, n, s, i, j),
 nm AS (SELECT l.f, l.n, l.j, sum(l.w * l.w) AS d, coalesce(max(o.e), 0) AS e FROM a l LEFT JOIN (SELECT u.f, u.n, u.j, sum(u.w * v.w) AS e FROM a u JOIN a v ON u.f = v.f AND u.n = v.n AND u.i = v.i AND v.j = u.j - 1 GROUP BY 1, 2, 3) o ON o.f = l.f AND o.n = l.n AND o.j = l.j GROUP BY 1, 2, 3),
 rh AS (SELECT a.f, a.n, a.j, x, sum(w * b) AS r FROM a JOIN px ON px.f = a.f AND px.i = a.i GROUP BY 1, 2, 3, 4),
 fw AS (SELECT rh.f, rh.n, rh.j, x, d + 2.220446049250313e-16::DOUBLE AS piv, r AS y, CAST(0 AS DOUBLE) AS l FROM rh JOIN nm USING (f, n, j) WHERE rh.j = 0
  UNION ALL SELECT fw.f, fw.n, fw.j + 1, fw.x, nm.d - nm.e / fw.piv * nm.e + 2.220446049250313e-16::DOUBLE, rh.r - nm.e / fw.piv * fw.y, nm.e / fw.piv FROM fw JOIN nm ON nm.f = fw.f AND nm.n = fw.n AND nm.j = fw.j + 1 JOIN rh ON rh.f = fw.f AND rh.n = fw.n AND rh.j = fw.j + 1 AND rh.x = fw.x),
 bw AS (SELECT f, n, j, x, y / piv AS v, l FROM fw WHERE j = n - 1 UNION ALL SELECT fw.f, fw.n, fw.j, fw.x, fw.y / fw.piv - bw.l * bw.v, fw.l FROM bw JOIN fw ON fw.f = bw.f AND fw.n = bw.n AND fw.j = bw.j - 1 AND fw.x = bw.x),
 rec AS (SELECT a.f, a.n, a.s, a.i, bw.x, sum(w * v) AS m FROM a JOIN bw ON bw.f = a.f AND bw.n = a.n AND bw.j = a.j GROUP BY 1, 2, 3, 4, 5)
 SELECT f AS frame_id, CAST(n AS VARCHAR) AS candidate_id, round(avg(abs(b - m)), 4) AS error, 'none' AS problem FROM rec JOIN px USING (f, i, x) WHERE x BETWEEN 5 AND 58 AND i BETWEEN 5 AND s - 6 GROUP BY f, n
 UNION ALL SELECT f, CAST(n AS VARCHAR), NULL, 'destination_out_of_range' FROM cand WHERE n >= s""",
    "plan_table": "SELECT CAST(p_size + 40 AS INTEGER) AS destination_size, count(*) AS requests, CASE WHEN p_size + 40 < 96 THEN 5 END AS half_bandwidth, CASE WHEN p_size + 40 < 96 THEN 'none' ELSE 'destination_out_of_range' END AS problem FROM part GROUP BY p_size",
    "capabilities": "SELECT * FROM (VALUES ('bilinear', ''), ('bicubic', 'b,c'), ('lanczos', 'taps'), ('spline16', ''), ('spline36', ''), ('spline64', '')) t(kernel_id, parameters)",
}
