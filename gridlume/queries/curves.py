"""Curve analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves
from .common import CURVE, curve, rounded, table

PLOT_BUCKETS = 10


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.smoothed(curve(spark, sf_dir)).select("run_id", "x", rounded("y"))


def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.local_minima(curves.smoothed(curve(spark, sf_dir))).select("run_id", "x", "metric")


def prominences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.prominences(curves.smoothed(curve(spark, sf_dir))).select("run_id", "x", rounded("prominence"))


def valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.valleys(curve(spark, sf_dir)).select("run_id", "key", "x", "metric", rounded("prominence"))


def valley_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.clusters(curves.valleys(curve(spark, sf_dir)), 0.2)
    return found.groupBy("cluster").agg(F.min("x").alias("height"), F.count(F.lit(1)).alias("members"), F.count_distinct("run_id").alias("run_count"), F.round(F.sum("prominence"), 4).alias("score"), F.min("metric").alias("metric"))


def valley_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.consensus(curves.valleys(curve(spark, sf_dir)), 0.2, 5).select("rank", "height", "run_count", rounded("score", 4), "metric")


def fallback_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.fallback_minimum(curve(spark, sf_dir))


def zoom_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = curves.zoomed(curve(spark, sf_dir), 5, 9).agg(F.count(F.lit(1)).alias("inside"))
    return inside.crossJoin(curves.zoomed(curve(spark, sf_dir), -9, -5).agg(F.count(F.lit(1)).alias("fallback")))


def decimate_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.decimated(curve(spark, sf_dir), PLOT_BUCKETS).select("run_id", "x", "metric")


def review_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("frame_index"), F.col("value").alias("error"))
    return curves.review(rows, 50.0, 20)


def worst_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curve(spark, sf_dir).select("run_id", F.col("x").cast("long").alias("frame_index"), F.col("metric").alias("error"))
    return curves.worst_in_range(rows, 10, 30)


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.run_comparison(curve(spark, sf_dir))


def perfect_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.perfect_count(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_discount").alias("metric")))


def plot_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.domain(curve(spark, sf_dir)).select(rounded("low"), rounded("high"))


def categorical_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("category"), F.col("value").alias("metric"))
    return curves.pivoted(rows, ["click", "error", "purchase", "signup", "view"])


def virtual_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.page(table(spark, sf_dir, "events").select("event_id", "value"), [F.desc("value"), "event_id"], 40, 80)


QUERIES = {f.__name__: f for f in (moving_average, local_minima, prominences, valleys, valley_clusters, valley_consensus, fallback_minimum, zoom_window, decimate_minmax, review_top_n, worst_in_range, run_comparison, perfect_count, plot_domain, categorical_pivot, virtual_page)}

_SMOOTH = f"""SELECT *, CASE WHEN n >= 5 THEN avg(l) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE avg(l) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS y
 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY x, key) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, log10(greatest(metric, 1e-12)) AS l FROM ({CURVE}))"""
_LOWS = f"SELECT * FROM (SELECT *, y < lag(y) OVER w AND y <= lead(y) OVER w AS low FROM ({_SMOOTH}) WINDOW w AS (PARTITION BY run_id ORDER BY i)) WHERE low AND n >= 3"
_SIDES = f"""WITH s AS ({_SMOOTH}), m AS ({_LOWS}), near AS (
 SELECT m.run_id, m.i AS pos, m.y AS bottom, s.i > m.i AS rgt, abs(s.i - m.i) AS gap, s.y FROM m JOIN s ON s.run_id = m.run_id AND s.i <> m.i AND abs(s.i - m.i) <= least(200, greatest(10, floor(m.n / 40.0 + 0.5)))),
 stops AS (SELECT run_id, pos, rgt, min(CASE WHEN y <= bottom THEN gap END) AS stop FROM near GROUP BY ALL),
 tops AS (SELECT near.run_id, near.pos, near.rgt, max(CASE WHEN stop IS NULL OR gap < stop THEN y END) AS top FROM near JOIN stops USING (run_id, pos, rgt) GROUP BY ALL),
 bounds AS (SELECT run_id, pos, min(top) AS bound, count(top) AS sides FROM tops GROUP BY ALL),
 proms AS (SELECT m.run_id, m.key, m.x, m.metric, CASE WHEN sides = 2 THEN bound - m.y ELSE 0 END AS prominence FROM m LEFT JOIN bounds b ON b.run_id = m.run_id AND b.pos = m.i)"""
_CLUSTERS = f"""{_SIDES}, v AS (SELECT * FROM proms WHERE prominence >= 0.1),
 c AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 0.2 THEN 1 ELSE 0 END) OVER (ORDER BY x, run_id, key) - 1 AS cluster FROM (SELECT *, x - lag(x) OVER (ORDER BY x, run_id, key) AS g FROM v))"""
ORACLES = {
    "moving_average": f"SELECT run_id, x, round(y, 6) AS y FROM ({_SMOOTH})",
    "local_minima": f"SELECT run_id, x, metric FROM ({_LOWS})",
    "prominences": f"{_SIDES} SELECT run_id, x, round(prominence, 6) AS prominence FROM proms",
    "valleys": f"{_SIDES} SELECT run_id, key, x, metric, round(prominence, 6) AS prominence FROM proms WHERE prominence >= 0.1",
    "valley_clusters": f"{_CLUSTERS} SELECT CAST(cluster AS BIGINT) AS cluster, min(x) AS height, count(*) AS members, count(DISTINCT run_id) AS run_count, round(sum(prominence), 4) AS score, min(metric) AS metric FROM c GROUP BY cluster",
    "valley_consensus": f"""{_CLUSTERS}, g AS (SELECT min(x) AS height, count(DISTINCT run_id) AS run_count, sum(prominence) AS score, min(metric) AS metric FROM c GROUP BY cluster)
 SELECT CAST(row_number() OVER (ORDER BY score DESC, run_count DESC, height) AS INTEGER) AS rank, height, run_count, round(score, 4) AS score, metric FROM g ORDER BY rank LIMIT 5""",
    "fallback_minimum": f"SELECT x, metric, run_id, key FROM ({CURVE}) ORDER BY metric, run_id, x LIMIT 1",
    "zoom_window": f"SELECT count(*) FILTER (x BETWEEN 5 AND 9) AS inside, count(*) AS fallback FROM ({CURVE})",
    "decimate_minmax": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY x, key) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM ({CURVE})),
 b AS (SELECT p.*, k FROM p JOIN range({PLOT_BUCKETS}) t(k) ON floor(k * (n / {PLOT_BUCKETS}.0::DOUBLE)) <= i AND i < floor((k + 1) * (n / {PLOT_BUCKETS}.0::DOUBLE))),
 e AS (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY metric, i) AS lo, row_number() OVER (PARTITION BY run_id, k ORDER BY metric DESC, i) AS hi FROM b)
 SELECT run_id, x, metric FROM p WHERE n <= 2 * {PLOT_BUCKETS} UNION ALL SELECT run_id, x, metric FROM e WHERE n > 2 * {PLOT_BUCKETS} AND (lo = 1 OR hi = 1)""",
    "review_top_n": "SELECT user_id AS run_id, event_id AS frame_index, value AS error FROM events WHERE value > 50 ORDER BY value DESC, user_id, event_id LIMIT 20",
    "worst_in_range": f"SELECT run_id, frame_index, error FROM (SELECT run_id, CAST(x AS BIGINT) AS frame_index, metric AS error, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, x) AS r FROM ({CURVE}) WHERE x BETWEEN 10 AND 30) WHERE r = 1",
    "run_comparison": f"SELECT run_id, n_points, x, metric, key FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n_points, row_number() OVER (PARTITION BY run_id ORDER BY metric, x, key) AS r FROM ({CURVE})) WHERE r = 1",
    "perfect_count": "SELECT l_suppkey AS run_id, count(*) FILTER (l_discount <= 1e-6) AS n_perfect FROM lineitem GROUP BY 1",
    "plot_domain": "SELECT round(a - (b - a) * 0.02, 6) AS low, round(b + (b - a) * 0.02, 6) AS high FROM (SELECT min(value) AS a, max(value) AS b FROM events)",
    "categorical_pivot": "SELECT user_id AS run_id, " + ", ".join(f"min(value) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "virtual_page": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 40 OFFSET 40",
}
