"""Frame streams and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers
from ..operators import frames, fusion
from ..sources import project
from .common import PRESENTED, STREAM, stream, table

BY = ("stream",)


def _presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.presented(stream(spark, sf_dir), BY)


def _scope(*scope, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frames.select_frames(_presented(spark, sf_dir), *scope, **options).select("stream", "frame_index", "event_id")

    return query


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.coverage(_presented(spark, sf_dir), frames.in_scope("every_n", 3, 2, 60), stream=BY)


def presentation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _presented(spark, sf_dir).select("stream", "decode_index", "frame_index")


def keyframe_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.anchored(_presented(spark, sf_dir), BY).select("stream", "decode_index", "keyframe_anchor", "leading")


def preceding_rap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.preceding_rap(_presented(spark, sf_dir), BY).select("stream", "decode_index", "rap_before")


def keyframe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.neighbours(_presented(spark, sf_dir), BY).select("stream", "frame_index", "previous_key", "next_key")


def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _presented(spark, sf_dir).withColumn("seconds", F.col("pts") * 1001 / 24000)
    targets = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 150 + 1).alias("stream"), numbers.round_scaled(F.abs("c_acctbal") / 5000, 4).alias("target_seconds")).distinct()
    return frames.nearest(shown, targets.join(shown.select("stream").distinct(), "stream", "left_semi"), BY)


def frame_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.window_of(_presented(spark, sf_dir), 5, 8).groupBy("stream").agg(F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), F.count(F.lit(1)).alias("n"))


def decode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of even numbers select densely, others every third frame."""
    chosen = frames.anchored(_presented(spark, sf_dir), BY).where("stream % 2 = 0 OR frame_index % 3 = 0")
    return frames.decode_runs(chosen, BY)


def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir)
    return frames.is_monotonic(rows, "dts", BY).withColumnRenamed("monotonic", "dts_ok").join(frames.is_monotonic(rows, "file_position", BY).withColumnRenamed("monotonic", "position_ok"), "stream")


def seek_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.seek_method(stream(spark, sf_dir), BY)


def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every stream against its index, in which every fifth time is one off and every seventh that of the frame before."""
    rows = stream(spark, sf_dir).withColumn("duration", F.lit(1001).cast("long"))
    off = F.when(F.col("decode_index") % 5 == 0, 1).otherwise(0)
    same = F.when(F.col("decode_index") % 7 == 0, F.lag("pts").over(Window.partitionBy("stream").orderBy("decode_index")))
    index = frames.presented(rows, BY).select("stream", "frame_index", F.coalesce(same, F.col("pts") + off).alias("pts"), "best_effort", F.when(F.col("decode_index") % 3 > 0, F.col("dts")).alias("dts"), "duration")
    return frames.matched(rows.select("stream", F.col("event_id").alias("decoded_id"), "pts", "best_effort", "dts", "duration"), index, BY)


def ordered_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), ((F.col("o_orderkey") * 37) % 5000).alias("frame_index"))
    return frames.ordered_subset_problem(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame_index")))


def _fusion_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers are recipes with a run each, parts are frames, discounts are errors."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("frame_index")).agg(F.min("l_discount").alias("error"))
    suppliers = table(spark, sf_dir, "supplier")
    return lines, suppliers.select(F.col("s_suppkey").alias("run_id"), F.col("s_suppkey").alias("recipe_id")), suppliers.select(F.col("s_suppkey").alias("recipe_id"), F.concat(F.lit("2024-01-"), F.col("s_nationkey").cast("string")).alias("created_at"), F.col("s_name").alias("name"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused(fusion.candidates(*_fusion_input(spark, sf_dir)))


def fusion_min_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).drop("candidates")


def fusion_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.statistics(_fused(spark, sf_dir))


def fusion_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.wins(_fused(spark, sf_dir), _fusion_input(spark, sf_dir)[2])


def fusion_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project.fusion_rows(_fused(spark, sf_dir), _fusion_input(spark, sf_dir)[2], "f,1", "source")
    return project.fusion_csv(rows).select("frame_index", "value")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are runs: statuses, priorities and customers give them their other fields."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.struct(
            F.when(F.col("o_orderkey") % 11 == 0, "height").otherwise("verification").alias("run_type"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "completed").otherwise("partial").alias("status"),
            (F.col("o_custkey") % 50).alias("source_id"),
            F.concat(F.lit("fp"), (F.col("o_custkey") % 50 + F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).cast("string")).alias("source_fingerprint"),
            F.when(F.col("o_orderkey") % 17 != 0, 0).alias("stream_index"),
            (F.col("o_custkey") % 3).alias("recipe_revision"),
            F.substring("o_orderpriority", 1, 1).alias("metric_key"),
            F.lit("h_only").alias("axis_mode"),
            F.lit("").alias("profile_id"),
            F.lit("raw").alias("math_mode"),
            F.lit(10).alias("expected"),
            F.lit(10).alias("selected"),
            (F.col("o_orderkey") % 19 == 0).cast("int").alias("failed"),
            F.lit(10).alias("n_frames"),
            (F.col("o_orderkey") % 23 == 0).cast("int").alias("bad_frames"),
        ).alias("run"),
        F.struct((F.col("o_custkey") % 50).alias("source_id"), F.lit("video").alias("kind"), F.when(F.col("o_custkey") % 7 == 0, "missing").otherwise("ready").alias("state"), F.concat(F.lit("fp"), (F.col("o_custkey") % 50).cast("string")).alias("fingerprint")).alias("source"),
        F.struct((F.col("o_custkey") % 9).alias("recipe_id"), (F.col("o_custkey") % 3).alias("revision"), F.when(F.col("o_orderkey") % 29 == 0, "9").otherwise(F.substring("o_orderpriority", 1, 1)).alias("metric_key"), F.lit("h_only").alias("axis_mode"), F.lit(None).cast("string").alias("profile_id"), F.lit(None).cast("string").alias("math_mode"), (F.col("o_custkey") % 31 != 0).alias("complete")).alias("recipe"),
    )


def fusion_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("o_orderkey", F.coalesce(fusion.eligibility(), F.lit("ok")).alias("reason"))


def fusion_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select("run.source_id", "recipe.recipe_id", "run.stream_index", "run.metric_key", "run.axis_mode", "run.profile_id", "run.math_mode")
    first = rows.groupBy("source_id", "recipe_id").agg(*(F.min(c).alias(c) for c in ("stream_index", "metric_key", "axis_mode", "profile_id", "math_mode")))
    return fusion.compatibility(first, ("source_id",)).select("source_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


QUERIES = {
    "scan_all": _scope("all", 1, 3, 40),
    "scan_every_n": _scope("every_n", 4, 1, None),
    "scan_i_picture": _scope("decoded_i_picture"),
    **{f.__name__: f for f in (coverage, presentation_order, keyframe_anchor, preceding_rap, keyframe_neighbours, nearest_frame, frame_window, decode_runs, monotonic, seek_method, identity_match, ordered_subset)},
    **{f.__name__: f for f in (fusion_min_error, fusion_statistics, fusion_wins, fusion_csv, fusion_eligibility, fusion_compatibility)},
}

_P = f"({PRESENTED})"
_ANCHORED = f"""SELECT *, frame_index < keyframe_anchor AS "leading" FROM (SELECT *, coalesce(last_value(CASE WHEN rap THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY decode_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS keyframe_anchor FROM {_P})"""
_LINES = "SELECT l_suppkey AS run_id, l_partkey AS frame_index, min(l_discount) AS error FROM lineitem GROUP BY 1, 2"
_FUSED = f"""SELECT frame_index, error AS fused_error, run_id AS winner_run_id, run_id AS winner_recipe_id, n AS candidate_count, ties > 1 AS tied FROM (
 SELECT f.*, row_number() OVER (PARTITION BY frame_index ORDER BY error, '2024-01-' || s_nationkey, run_id) AS r, count(*) OVER (PARTITION BY frame_index) AS n, count(*) OVER (PARTITION BY frame_index, error) AS ties
 FROM ({_LINES}) f JOIN supplier ON s_suppkey = run_id) WHERE r = 1"""
ORACLES = {
    "scan_all": f"SELECT stream, frame_index, event_id FROM {_P} WHERE frame_index BETWEEN 3 AND 40",
    "scan_every_n": f"SELECT stream, frame_index, event_id FROM {_P} WHERE frame_index >= 1 AND (frame_index - 1) % 4 = 0",
    "scan_i_picture": f"SELECT stream, frame_index, event_id FROM {_P} WHERE coalesce(picture_type = 'I', key_frame, false)",
    "coverage": f"""SELECT stream, count(*) AS eligible, count(*) FILTER (s) AS selected, count(*) FILTER (s AND error IS NOT NULL) AS processed, count(*) FILTER (s AND error IS NULL) AS failed
 FROM (SELECT *, frame_index BETWEEN 2 AND 60 AND (frame_index - 2) % 3 = 0 AS s FROM {_P}) GROUP BY stream""",
    "presentation_order": f"SELECT stream, decode_index, frame_index FROM {_P}",
    "keyframe_anchor": f'SELECT stream, decode_index, keyframe_anchor, "leading" FROM ({_ANCHORED})',
    "preceding_rap": f"SELECT stream, decode_index, last_value(CASE WHEN rap THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY decode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rap_before FROM {_P}",
    "keyframe_neighbours": f"""SELECT stream, frame_index, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY stream ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous_key,
 coalesce(first_value(k IGNORE NULLS) OVER (PARTITION BY stream ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(frame_index) OVER (PARTITION BY stream)) AS next_key FROM (SELECT *, CASE WHEN key_frame THEN frame_index END AS k FROM {_P})""",
    "nearest_frame": f"""SELECT stream, target_seconds, frame_index FROM (SELECT t.stream, target_seconds, frame_index, row_number() OVER (PARTITION BY t.stream, target_seconds ORDER BY abs(seconds - target_seconds), frame_index) AS r
 FROM (SELECT DISTINCT c_custkey % 150 + 1 AS stream, round(abs(c_acctbal) / 5000, 4) AS target_seconds FROM customer) t JOIN (SELECT *, pts * 1001 / 24000.0::DOUBLE AS seconds FROM {_P} WHERE pts IS NOT NULL) f USING (stream)) WHERE r = 1""",
    "frame_window": f"SELECT stream, min(frame_index) AS first, max(frame_index) AS last, count(*) AS n FROM {_P} WHERE frame_index BETWEEN -3 AND 13 GROUP BY stream",
    "decode_runs": f"""SELECT stream, CAST(run AS BIGINT) AS run, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS frames, arg_min(keyframe_anchor, frame_index) AS anchor, bool_or("leading") AS any_leading FROM (
 SELECT *, sum(CASE WHEN le IS NULL OR le <> extradata OR (NOT dense AND la <> keyframe_anchor) THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY frame_index) - 1 AS run FROM (
 SELECT *, lag(extradata) OVER w AS le, lag(keyframe_anchor) OVER w AS la, 2 * count(*) OVER (PARTITION BY stream) >= max(frame_index) OVER (PARTITION BY stream) - min(frame_index) OVER (PARTITION BY stream) + 1 AS dense
 FROM ({_ANCHORED}) WHERE stream % 2 = 0 OR frame_index % 3 = 0 WINDOW w AS (PARTITION BY stream ORDER BY frame_index))) GROUP BY stream, run""",
    "monotonic": f"""SELECT stream, bool_and(dts IS NOT NULL AND coalesce(dts >= ld, true)) AS dts_ok, bool_and(file_position IS NOT NULL AND coalesce(file_position >= lp, true)) AS position_ok
 FROM (SELECT *, lag(dts) OVER w AS ld, lag(file_position) OVER w AS lp FROM ({STREAM}) WINDOW w AS (PARTITION BY stream ORDER BY decode_index)) GROUP BY stream""",
    "seek_method": f"""SELECT stream, CASE WHEN count(pts) = count(*) AND count(DISTINCT pts) = count(*) THEN 'pts' WHEN count(dts) = count(*) AND count(DISTINCT dts) = count(*) THEN 'dts'
 WHEN count(file_position) = count(*) AND count(DISTINCT file_position) = count(*) THEN 'file_position' ELSE 'sample_order' END AS method FROM ({STREAM}) GROUP BY stream""",
    "identity_match": f"""WITH i AS (SELECT stream, frame_index, coalesce(CASE WHEN decode_index % 7 = 0 THEN lag(pts) OVER (PARTITION BY stream ORDER BY decode_index) END, pts + CASE WHEN decode_index % 5 = 0 THEN 1 ELSE 0 END) AS pts, best_effort, CASE WHEN decode_index % 3 > 0 THEN dts END AS dts FROM {_P}),
 d AS (SELECT stream, event_id AS decoded_id, pts, best_effort, dts FROM ({STREAM})),
 c AS (SELECT d.stream, decoded_id, frame_index, CASE WHEN d.pts = i.pts THEN 16 ELSE 0 END + CASE WHEN d.best_effort = i.best_effort THEN 16 ELSE 0 END + CASE WHEN d.best_effort = i.pts THEN 12 ELSE 0 END + CASE WHEN d.pts = i.best_effort THEN 12 ELSE 0 END AS shown,
  CASE WHEN d.dts = i.dts THEN 6 ELSE 0 END + 1 AS rest, coalesce(d.pts, d.best_effort) IS NOT NULL AND coalesce(i.pts, i.best_effort) IS NOT NULL AS timed,
  coalesce(d.pts IN (i.pts, i.best_effort) OR d.best_effort IN (i.pts, i.best_effort), false) OR coalesce(d.dts = i.dts, false) AS meets FROM d JOIN i ON d.stream = i.stream),
 p AS (SELECT stream, decoded_id, frame_index, CASE WHEN timed AND shown = 0 THEN 0 ELSE shown + rest END AS score FROM c WHERE meets),
 t AS (SELECT *, max(score) OVER (PARTITION BY stream, decoded_id) AS top FROM p WHERE score > 0)
 SELECT stream, decoded_id, CASE WHEN count(*) = 1 THEN min(frame_index) END AS frame_index, CAST(top AS INTEGER) AS score, CASE WHEN count(*) > 1 THEN 'ambiguous_timestamps' END AS problem FROM t WHERE score = top GROUP BY stream, decoded_id, top""",
    "ordered_subset": """SELECT place, problem FROM (SELECT place, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN frame_index <= b THEN 'not_ascending' END AS problem
 FROM (SELECT *, lag(frame_index) OVER (ORDER BY place) AS b FROM (SELECT o_orderkey AS place, (o_orderkey * 37) % 5000 AS frame_index FROM orders)) LEFT JOIN customer ON c_custkey = frame_index) WHERE problem IS NOT NULL""",
    "fusion_min_error": _FUSED,
    "fusion_statistics": f"SELECT count(*) AS total_frames, count(*) FILTER (candidate_count = 1) AS single_candidate_frames, count(*) FILTER (candidate_count <> 1) AS multi_candidate_frames, count(*) FILTER (tied) AS tied_frames FROM ({_FUSED})",
    "fusion_wins": f"SELECT s_suppkey AS recipe_id, coalesce(w, 0) AS wins FROM supplier LEFT JOIN (SELECT winner_recipe_id, count(*) AS w FROM ({_FUSED}) GROUP BY 1) ON winner_recipe_id = s_suppkey",
    "fusion_csv": f"""SELECT f.frame_index, concat_ws(',', '"f,1"', 'source', f.frame_index, regexp_replace(CAST(CAST(fused_error AS DECIMAL(30,12)) AS VARCHAR), '\\.?0+$', ''), winner_run_id, winner_recipe_id, w.s_name, candidate_count, l.run_id, l.run_id, c.s_name,
 regexp_replace(CAST(CAST(l.error AS DECIMAL(30,12)) AS VARCHAR), '\\.?0+$', ''), CASE WHEN l.run_id = winner_run_id THEN 'true' ELSE 'false' END) AS value
 FROM ({_FUSED}) f JOIN ({_LINES}) l USING (frame_index) JOIN supplier w ON w.s_suppkey = winner_run_id JOIN supplier c ON c.s_suppkey = l.run_id""",
    "fusion_eligibility": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not_verification_run' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_not_completed' WHEN o_custkey % 7 = 0 THEN 'source_unavailable' WHEN o_orderkey % 13 = 0 THEN 'source_fingerprint_mismatch'
 WHEN o_orderkey % 17 = 0 THEN 'stream_missing' WHEN o_custkey % 31 = 0 THEN 'recipe_snapshot_missing' WHEN o_orderkey % 29 = 0 THEN 'metric_mismatch' WHEN o_orderkey % 23 = 0 THEN 'invalid_frames' WHEN o_orderkey % 19 = 0 THEN 'metrics_incomplete' ELSE 'ok' END AS reason FROM orders""",
    "fusion_compatibility": """SELECT source_id, CASE WHEN count(*) < 2 THEN 'need_two_runs' WHEN count(DISTINCT coalesce(s, -1)) > 1 THEN 'stream_mismatch' WHEN count(DISTINCT m) > 1 THEN 'metric_mismatch' ELSE 'ok' END AS reason FROM (
 SELECT o_custkey % 50 AS source_id, o_custkey % 9 AS recipe_id, min(CASE WHEN o_orderkey % 17 <> 0 THEN 0 END) AS s, min(substr(o_orderpriority, 1, 1)) AS m FROM orders GROUP BY 1, 2) GROUP BY 1""",
}
