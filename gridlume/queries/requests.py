"""Requests, their jobs and rows of their results over the fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves, requests
from .common import table

#: Fields of a made-up request as SQL over orders that both engines read, so that many rules are broken.
_FIELDS = {
    "mode": "CASE WHEN o_orderkey % 29 = 0 THEN 'other' WHEN o_orderkey % 3 = 0 THEN 'height' WHEN o_orderkey % 3 = 1 THEN 'kernel' ELSE 'verify' END",
    "sample_id": "CASE WHEN o_orderkey % 23 > 0 THEN 's' END",
    "source_id": "CASE WHEN o_orderkey % 19 > 0 THEN 's' ELSE '' END",
    "source_path": "'/p'",
    "recipe_id": "CASE WHEN o_orderkey % 17 > 0 THEN 'r' END",
    "profile_id": "CASE WHEN o_orderkey % 13 > 0 THEN 'p' END",
    "kernel_id": "CASE WHEN o_custkey % 11 > 0 THEN 'bicubic' END",
    "geometry": "CASE WHEN o_custkey % 7 > 0 THEN 'g' END",
    "n_candidates": "o_custkey % 12",
    "concurrency": "o_custkey % 10",
    "stream_index": "o_custkey % 9 - 1",
    "selection": "CASE WHEN o_orderkey % 2 = 0 THEN 'every_n' ELSE 'all' END",
    "every_n": "CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 6 END",
    "start_frame": "CASE WHEN o_custkey % 4 > 0 THEN o_orderkey % 50 END",
    "end_frame": "o_custkey % 60",
    "threshold": "CAST(CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE 0.015 END AS DOUBLE)",
    "norm": "CAST(CASE WHEN o_orderkey % 37 = 0 THEN 1.5 ELSE 1 END AS DOUBLE)",
}


def shape_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kernels = F.expr("slice(array('bicubic:0', 'bicubic:1', IF(o_orderkey % 8 = 1, 'bicubic:0', 'lanczos:3')), 1, CAST(o_custkey % 4 AS INT))")
    crops = F.expr("array(CAST(0 AS BIGINT), CAST(o_orderkey % 41 AS BIGINT) - 1)")
    rows = orders.select("o_orderkey", F.struct(*(F.expr(v).alias(k) for k, v in _FIELDS.items()), kernels.alias("kernels"), crops.alias("crops")).alias("r"))
    found = [F.coalesce(requests.shape_problem("r", m), F.lit("none")).alias(m) for m in ("height", "kernel", "verify")]
    return rows.select("o_orderkey", *found)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_custkey").cast("string").alias("source_id"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("string")).alias("sample_id"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("CASE WHEN o_orderkey % 5 < 2 THEN 'verification' WHEN o_orderkey % 5 = 2 THEN 'verify' ELSE 'kernel' END").alias("run_type"),
        F.when(F.col("o_orderkey") % 4 > 0, F.when(F.col("o_orderkey") % 4 == 1, "m2").otherwise("m1")).alias("metric_key"),
        F.expr("filter(array(named_struct('kernel_id', 'bicubic', 'parameters', array(named_struct('name', 'b', 'value', '0'), named_struct('name', 'c', 'value', CAST(o_orderkey % 3 AS STRING))), 'metric', CAST(o_totalprice AS DOUBLE)), named_struct('kernel_id', 'bilinear', 'parameters', CAST(NULL AS ARRAY<STRUCT<name: STRING, value: STRING>>), 'metric', CAST(o_custkey AS DOUBLE))), x -> o_orderkey % 6 > 0)").alias("results"),
    )


def kernel_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_name").alias("label"))
    return requests.kernel_result_rows(_runs(spark, sf_dir), samples, "m1")


def incompatible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.incompatible_runs(_runs(spark, sf_dir), "m1")


def verification_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.verification_runs(_runs(spark, sf_dir)).select("run_id", "source_id", "place")


def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.expr("CASE event_type WHEN 'signup' THEN 'queue' WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'completed' ELSE 'running' END")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), event.alias("event"), (F.floor("value") - 20).alias("total"))
    return requests.job_requests(rows)


def metric_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a result table in each of its orders."""
    rows = table(spark, sf_dir, "events").select("event_id", F.floor("value").alias("metric"), F.col("event_id").alias("place"))
    pages = [curves.page(rows, requests.by_metric(d), 20, 60).select(F.lit(d).alias("direction"), "event_id") for d in ("none", "asc", "desc")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


QUERIES = {f.__name__: f for f in (shape_guards, kernel_result_rows, incompatible_runs, verification_runs, job_requests, metric_pages)}

_METRIC = "WHEN o_orderkey % 41 = 0 THEN 'metric_crop_invalid' WHEN threshold < 0 THEN 'metric_exclusion_invalid' WHEN norm = 1.5 THEN 'metric_p_norm_invalid'"
_REQUESTS = "SELECT o_orderkey, o_custkey, " + ", ".join(f'{v} AS "{k}"' for k, v in _FIELDS.items()) + " FROM orders"
ORACLES = {
    "shape_guards": f"""SELECT o_orderkey, CASE WHEN mode <> 'height' THEN 'height_mode_mismatch' WHEN sample_id IS NULL THEN 'height_sample_required' WHEN kernel_id IS NULL THEN 'height_kernel_required' WHEN n_candidates = 0 THEN 'height_grid_empty' WHEN n_candidates = 1 THEN 'height_grid_too_small'
 {_METRIC} WHEN profile_id IS NULL THEN 'height_profile_required' ELSE 'none' END AS height,
 CASE WHEN mode <> 'kernel' THEN 'kernel_mode_mismatch' WHEN sample_id IS NULL THEN 'kernel_sample_required' WHEN geometry IS NULL THEN 'kernel_geometry_required' WHEN o_custkey % 4 = 0 THEN 'kernel_list_empty' WHEN o_custkey % 4 = 1 THEN 'kernel_list_too_small' WHEN o_custkey % 4 = 3 AND o_orderkey % 8 = 1 THEN 'kernel_list_duplicate'
 {_METRIC} WHEN profile_id IS NULL THEN 'kernel_profile_required' ELSE 'none' END AS kernel,
 CASE WHEN mode <> 'verify' THEN 'verify_mode_mismatch' WHEN source_id = '' THEN 'verify_source_required' WHEN recipe_id IS NULL THEN 'verify_recipe_required' WHEN kernel_id IS NULL THEN 'verify_kernel_required' WHEN geometry IS NULL THEN 'verify_geometry_required' WHEN concurrency NOT BETWEEN 1 AND 8 THEN 'verify_concurrency_invalid'
 WHEN stream_index < 0 THEN 'verify_stream_required' WHEN selection = 'every_n' AND coalesce(every_n, 0) < 1 THEN 'verify_every_n_invalid' WHEN start_frame > end_frame THEN 'verify_range_invalid' {_METRIC} ELSE 'none' END AS verify FROM ({_REQUESTS})""",
    "kernel_result_rows": """WITH r AS (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_custkey AS VARCHAR) END AS s FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 6 > 0),
 k AS (SELECT *, 'bicubic' AS kernel_id, 'bicubic (b=0, c=' || o_orderkey % 3 || ')' AS kernel_label, CAST(o_totalprice AS DOUBLE) AS metric FROM r UNION ALL SELECT *, 'bilinear', 'bilinear', CAST(o_custkey AS DOUBLE) FROM r)
 SELECT CAST(o_orderkey AS VARCHAR) AS run_id, coalesce(s, '') AS sample_id, kernel_id, kernel_label, metric, coalesce(c_name, s, '—') AS sample_label FROM k LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = s AND c_custkey % 2 = 0""",
    "incompatible_runs": "SELECT count(*) AS incompatible FROM orders WHERE o_orderkey % 4 = 1",
    "verification_runs": "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS place FROM orders WHERE o_orderkey % 5 < 3",
    "job_requests": """WITH q AS (SELECT user_id, max(event_id) AS since FROM events WHERE event_type = 'signup' GROUP BY 1), e AS (SELECT q.user_id, since, min(event_id) FILTER (event_type = 'purchase') AS stop, min(event_id) FILTER (event_type = 'error') AS asked FROM q LEFT JOIN events v ON v.user_id = q.user_id AND v.event_id > since GROUP BY 1, 2)
 SELECT e.user_id AS job_id, greatest(0, CAST(floor(value) AS BIGINT) - 20) AS total, stop IS NOT NULL AS ended, coalesce(asked < coalesce(stop, asked + 1), false) AS cancel_requested FROM e JOIN events v ON v.event_id = since""",
    "metric_pages": " UNION ALL ".join(f"(SELECT '{d}' AS direction, event_id FROM events ORDER BY {o} event_id LIMIT 40 OFFSET 20)" for d, o in (("none", ""), ("asc", "floor(value) ASC,"), ("desc", "floor(value) DESC,"))),
}
