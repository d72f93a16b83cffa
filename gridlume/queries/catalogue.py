"""The catalogue, progress and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids, numbers
from ..operators import catalog
from ..streaming import verify
from .common import rounded, table


def series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are runs, customers samples; building customers are hidden."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("sample_id"), F.when(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 5 == 0, "w_only").otherwise("h_only")).alias("axis_mode"), F.substring("o_orderpriority", 1, 1).alias("metric_key"), (F.col("o_orderstatus") != "P").alias("has_series"), F.lit("lanczos").alias("kernel_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(3)).alias("taps"))
    customers = table(spark, sf_dir, "customer")
    shown, _ = catalog.series_table(runs, customers.select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("label")), customers.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sample_id")), "1", "h_only")
    return shown.select("run_id", "sample_label", "kernel_key")


def series_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("sample_id"), F.lit("h_only").alias("axis_mode"), F.substring("o_orderpriority", 1, 1).alias("metric_key"), F.lit(True).alias("has_series"), F.lit("lanczos").alias("kernel_id"), F.lit(3).alias("taps"))
    none = spark.createDataFrame([], "sample_id BIGINT")
    return catalog.series_table(runs, none.withColumn("label", F.lit("")), none, "1")[1]


def ungrouped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderdate").alias("created_at"))
    return catalog.ungrouped(runs, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("group_id"))).select("run_id", "group_id")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'queued' END ELSE 'failed' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("group_id"), phase.alias("phase"), (F.col("o_orderkey") % 100).alias("completed"), F.lit(100).cast("long").alias("total"), F.round(F.col("o_totalprice") / 1000, 3).alias("fps"), (F.col("o_orderkey") % 50).alias("rate_completed"), (F.col("o_custkey") % 7 * 100).alias("rate_ms"), F.substring("o_orderpriority", 1, 1).alias("backend"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey")).alias("updated_ms"))


def group_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.group_progress(_jobs(spark, sf_dir), 1000).select("id", "phase", "completed", "total", rounded("fps_current", 3), rounded("fps_average", 6), "backend", "active_jobs")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a job's progress, in which views and clicks are measured phases and others aren't; rates by second. Times are the nearest milliseconds."""
    phase = F.expr("CASE event_type WHEN 'view' THEN 'candidates' WHEN 'click' THEN 'verify' ELSE event_type END")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.expr("round(unix_micros(CAST(ts AS TIMESTAMP)), -3) DIV 1000").alias("at_ms"), (F.col("event_id") % 1000).alias("completed"), phase.alias("phase"))
    return catalog.throughput(rows).select("job_id", "phase", "completed", numbers.round_scaled(F.col("fps_average"), 6).alias("fps_average"))


def terminal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("event_id") % 3 == 0, F.format_string('{"telemetry":{"candidate_ms":%d},"candidates":[1,2,3]}', F.col("event_id") % 50)).when(F.col("event_id") % 3 == 1, F.format_string('{"telemetry":{"stream_ms":%d},"frames_completed":%d}', F.col("event_id") % 40, F.col("user_id"))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", F.round(catalog.terminal_rate(payload, F.lit(7)), 6).alias("rate"))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return grids.first_of_each(rows, "p_brand", "p_partkey")


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "samples": (table(spark, sf_dir, "customer").where("c_custkey > 20").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")), "id"),
        "runs": (table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sample")), "id"),
    }
    return catalog.integrity_problems(tables, [("runs", "sample", "samples")])


def repeated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.repeated_reviews(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")))


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labelled = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return catalog.missing_sources(docs.select("doc_id", F.col("doc_id").alias("path")), labelled.select(F.col("doc_id").alias("path"))).select("doc_id")


def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    changed = catalog.upsert(parts, parts.where("p_size < 10").withColumn("p_size", F.col("p_size") + 100), "p_partkey")
    return catalog.delete(changed, parts.where("p_size > 45"), "p_partkey")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), "c_acctbal")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("group_id"))
    reviews = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    left = catalog.delete_group(groups, runs, reviews, groups.where("c_acctbal < 0"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(left[0], "groups").crossJoin(count(left[1], "runs")).crossJoin(count(left[2], "reviews"))


def ready_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return catalog.ready_ids(n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("source_id")), n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("source_id")))


def asset_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("fingerprint"), F.lit(0).alias("stream"), F.lit(64).alias("width"), F.lit(96).alias("height"), F.col("l_partkey").alias("frame_index"))
    return catalog.asset_work(rows).select("path", "fingerprint", F.size("frames").cast("long").alias("n_frames"), "batched")


def uncached_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("frame_index"))
    return catalog.uncached(wanted, table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("frame_index")), ["frame_index"])


def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("stream"), F.floor(F.col("value") / 10).alias("frame_index"))
    return catalog.duplicate_samples(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).select("event_id")


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("path"), F.md5("text").alias("fingerprint"))
    return catalog.merged_sources(rows).select("source_id")


def recent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recent(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("opened_at")))


def cache_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_nationkey").cast("long") * (1 << 20)).alias("bytes"), F.col("s_acctbal").alias("modified"))
    return catalog.cache_to_prune(files).select("path")


def samples_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("sample_id"), F.col("c_custkey").alias("sample_order"))
    return catalog.samples_by_source(rows).select("source_id", "first_order", F.size("samples").cast("long").alias("n"), F.array_join(F.transform(F.slice("samples", 1, 3), lambda s: s.cast("string")), ",").alias("first_three"))


def recipe_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("recipe_id"), F.col("s_acctbal").alias("updated_at"))
    latest = catalog.latest_recipe(recipes).select(F.lit("latest").alias("kind"), "recipe_id")
    current = catalog.current_recipe(recipes, recipes.where("recipe_id = 3")).select(F.lit("current").alias("kind"), "recipe_id")
    fallback = catalog.current_recipe(recipes, recipes.where("recipe_id < 0")).select(F.lit("fallback").alias("kind"), "recipe_id")
    return latest.unionByName(current).unionByName(fallback)


def removable_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.removable(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("recipe_id")), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("recipe_id")))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") == 0, "missing").otherwise("ready").alias("state"))
    samples = table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("included"))
    return catalog.readiness(sources, samples, table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").alias("status")))


def run_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("included"))
    sources = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("source_id"), F.when(F.col("n_regionkey") == 2, "indexing").otherwise("ready").alias("state"))
    kernels = spark.createDataFrame([("bilinear", None), ("lanczos", "lanczos_taps_out_of_range")], "kernel_id STRING, kernel_problem STRING")
    return catalog.plan_height_runs(samples, sources, kernels).groupBy("kernel_id", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def group_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("sample_id"), F.col("l_linestatus").alias("kernel_id"))
    return catalog.group_type(rows, "g").groupBy("group_type").agg(F.count(F.lit(1)).alias("n"))


def exploded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    result = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"candidates":[{"id":"'), e, F.lit('.5","error":0.25},{"id":"7","error":null}]}'))).otherwise(F.concat(F.lit('{"frames":[{"frameIndex":'), e, F.lit(',"error":0.5}]}')))
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 2 == 0, "height").otherwise("verification").alias("run_type"), result.alias("result"))
    return catalog.exploded_results(runs)


def coverage_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'running' END AS status"), F.when(F.col("o_orderkey") % 2 == 0, "all").otherwise("every_n").alias("selection"), (F.col("o_orderkey") % 9).alias("completed"), F.lit(9).cast("long").alias("total"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(4).cast("long")).alias("processed"), F.lit(None).cast("long").alias("eligible"), F.lit(5).cast("long").alias("stored"))
    return catalog.coverage_display(rows).groupBy("text", F.coalesce("badge", F.lit("none")).alias("badge"), "metrics_incomplete").agg(F.count(F.lit(1)).alias("n"))


def coverage_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.format_string('{"selection":"%s","eligible":%d,"selected":%d,"processed":3,"failed":0}', F.when(F.col("event_type") == "view", "all").when(F.col("event_type") == "click", "every_n").otherwise("odd"), F.col("event_id"), F.col("event_id") % 5 - 1)
    return table(spark, sf_dir, "events").select("event_id", catalog.wire_coverage(json).alias("c")).where("c IS NOT NULL").select("event_id", "c.selection", "c.eligible", "c.selected")


def _kernel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.expr("CASE p_size % 3 WHEN 0 THEN 'lanczos' WHEN 1 THEN 'bicubic' ELSE 'zz' END").alias("kernel_id"), F.when(F.col("p_size") % 3 == 1, F.col("p_size") / 10).alias("b"), F.lit(None).cast("double").alias("c"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("taps"), F.col("p_brand").alias("sample_label"))


def kernel_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place in the canonical order."""
    return catalog.numbered_kernel_rows(_kernel_rows(spark, sf_dir)).select("run_id", "kernel_id", "sample_label", "row_number")


def lost_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lost_jobs(_jobs(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("job_id")))


def cancelled_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.completed_prefix(table(spark, sf_dir, "events"), F.col("event_type") != "error", "event_id", ("user_id",)).select("user_id", "event_id")


def event_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are jobs: errors and purchases end them."""
    e = F.expr("CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' ELSE 'progress' END")
    return verify.reduced(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), e.alias("event"), F.floor("value").alias("completed"), F.lit(500).cast("long").alias("total")))


def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("NOT (conv_id % 5 = 0 AND turn = 1) AND NOT (conv_id % 7 = 0 AND turn = 0)").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"))
    declared = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.count(F.lit(1)).alias("total"))
    return verify.sequence_problems(turns, declared)


def display_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return verify.throttled(rows, 3_600_000).select(F.unix_seconds("window_start").alias("start_s"), "frames", "last_seq")


def resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"))
    return verify.resumed(turns, turns.where("seq < 2 AND stream_id % 2 = 0"))


QUERIES = {
    f.__name__: f
    for f in (series_table, series_incompatible, ungrouped_runs, group_progress, throughput, terminal_rates, dedup_first_wins, integrity_violations, repeated_reviews, missing_sources, upsert_delete, cascade_delete, ready_sources, asset_work, uncached_assets, duplicate_samples, merged_sources, recent_projects, cache_pruning, samples_by_source, recipe_choice, removable_recipes, readiness, run_planning, group_types, exploded_results, coverage_badges, coverage_wire, kernel_row_order, lost_jobs, cancelled_prefix, event_reduction, sequence_check, display_windows, resumed_stream)
}

_JOBS = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS group_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'queued' END ELSE 'failed' END AS phase,
 o_orderkey % 100 AS completed, 100 AS total, round(o_totalprice / 1000, 3) AS fps, o_orderkey % 50 AS rate_completed, o_custkey % 7 * 100 AS rate_ms, substr(o_orderpriority, 1, 1) AS backend, epoch_ms(o_orderdate) + o_orderkey AS updated_ms FROM orders"""
ORACLES = {
    "series_table": """SELECT o_orderkey AS run_id, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS sample_label, CASE WHEN o_orderkey % 2 = 0 THEN 'lanczos@3' ELSE 'lanczos' END AS kernel_key FROM orders LEFT JOIN customer ON c_custkey = o_custkey
 WHERE coalesce(c_mktsegment, '') <> 'BUILDING' AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0) AND substr(o_orderpriority, 1, 1) = '1' AND o_orderstatus <> 'P'""",
    "series_incompatible": "SELECT count(*) FILTER (substr(o_orderpriority, 1, 1) <> '1') AS incompatible FROM orders",
    "ungrouped_runs": "SELECT o_orderkey AS run_id, o_custkey AS group_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "group_progress": f"""SELECT coalesce(group_id, job_id) AS id, ['running', 'queued', 'failed', 'partial', 'cancelled', 'completed'][min(list_position(['running', 'queued', 'failed', 'partial', 'cancelled', 'completed'], phase))] AS phase, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(total) AS BIGINT) AS total,
 round(sum(fps) FILTER (phase = 'running'), 3) AS fps_current, round(sum(rate_completed) FILTER (rate_ms > 0 AND rate_completed > 0) * 1000.0 / sum(rate_ms) FILTER (rate_ms > 0 AND rate_completed > 0), 6) AS fps_average,
 CASE WHEN count(DISTINCT backend) = 1 THEN max(backend) END AS backend, count(*) FILTER (phase IN ('queued', 'running')) AS active_jobs FROM ({_JOBS}) GROUP BY 1 ORDER BY max(updated_ms) DESC, 1 LIMIT 1000""",
    "throughput": """WITH e AS (SELECT user_id AS job_id, epoch_ms(ts) AS t, event_id % 1000 AS done, CASE event_type WHEN 'view' THEN 'candidates' WHEN 'click' THEN 'verify' ELSE event_type END AS phase FROM events),
 o AS (SELECT *, row_number() OVER w AS place, lag(phase) OVER w AS before, lag(t) OVER w AS earlier FROM e WINDOW w AS (PARTITION BY job_id ORDER BY t, done, phase)),
 s AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM phase THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY place) AS part FROM o),
 g AS (SELECT job_id, part, any_value(phase) AS phase, max(done) AS done, max(t) - coalesce(arg_min(earlier, place), min(t)) AS ms FROM s GROUP BY 1, 2),
 m AS (SELECT * FROM g WHERE phase IN ('candidates', 'verify'))
 SELECT j.job_id, arg_max(j.phase, j.part) AS phase, coalesce((SELECT arg_max(m.done, m.part) FROM m WHERE m.job_id = j.job_id), 0) AS completed,
 round((SELECT arg_max(m.done * 1000.0 / m.ms, m.part) FROM m WHERE m.job_id = j.job_id AND m.ms > 0 AND m.done > 0), 6) AS fps_average FROM g j GROUP BY j.job_id""",
    "terminal_rates": """SELECT event_id, round(CASE WHEN event_id % 3 = 0 AND event_id % 50 > 0 THEN 3000.0 / (event_id % 50) WHEN event_id % 3 = 1 AND event_id % 40 > 0 THEN user_id * 1000.0 / (event_id % 40) END, 6) AS rate FROM events""",
    "dedup_first_wins": "SELECT p_partkey, p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r = 1",
    "integrity_violations": """SELECT 'duplicate_id' AS problem, min(t) AS table_name, id FROM (SELECT 'samples' AS t, 'c' || c_custkey AS id FROM customer WHERE c_custkey > 20 UNION ALL SELECT 'runs', 'c' || o_orderkey FROM orders) GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT DISTINCT 'missing_reference', 'runs.sample', 'c' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 20)""",
    "repeated_reviews": "SELECT l_orderkey AS run_id, count(*) AS reviews FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "missing_sources": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "upsert_delete": "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_size <= 45",
    "cascade_delete": """SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS groups, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS runs,
 (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)) AS reviews""",
    "ready_sources": "SELECT n_nationkey AS source_id FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0",
    "asset_work": "SELECT l_suppkey AS path, l_returnflag AS fingerprint, count(DISTINCT l_partkey) AS n_frames, count(DISTINCT l_partkey) >= 2 AS batched FROM lineitem GROUP BY 1, 2",
    "uncached_assets": "SELECT DISTINCT l_partkey AS frame_index FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)",
    "duplicate_samples": """WITH r AS (SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS s, floor(value / 10) AS f FROM events)
 SELECT event_id FROM r c WHERE event_id % 2 = 1 AND EXISTS (SELECT 1 FROM r x WHERE x.event_id % 2 = 0 AND x.user_id = c.user_id AND x.s IS NOT DISTINCT FROM c.s AND x.f = c.f)""",
    "merged_sources": "SELECT min(doc_id) AS source_id FROM documents GROUP BY source, text",
    "recent_projects": "SELECT user_id AS path, max(event_id) AS opened_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "cache_pruning": "SELECT path FROM (SELECT s_suppkey AS path, row_number() OVER w AS n, sum(s_nationkey * 1048576) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM supplier WINDOW w AS (ORDER BY s_acctbal DESC, s_suppkey)) WHERE n > 64 OR b > 536870912",
    "samples_by_source": "SELECT c_nationkey AS source_id, min(c_custkey) AS first_order, count(*) AS n, array_to_string(list(CAST(c_custkey AS VARCHAR) ORDER BY c_custkey)[1:3], ',') AS first_three FROM customer GROUP BY 1",
    "recipe_choice": "SELECT kind, CASE WHEN kind = 'current' THEN 3 ELSE (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) END AS recipe_id FROM (VALUES ('latest'), ('current'), ('fallback')) t(kind)",
    "removable_recipes": "SELECT p_partkey AS recipe_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "readiness": """SELECT (SELECT bool_or(n_regionkey <> 0) FROM nation) AS has_ready_source, (SELECT bool_or(c_acctbal > 0) FROM customer) AS has_included_sample, (SELECT count(*) > 0 FROM supplier) AS has_recipe,
 (SELECT bool_or(o_orderstatus = 'F') FROM orders) AS has_result, (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS missing_sources""",
    "run_planning": """SELECT k AS kernel_id, CASE WHEN n_nationkey IS NULL THEN 'source_missing' WHEN n_regionkey = 2 THEN 'source_not_ready' WHEN k = 'lanczos' THEN 'lanczos_taps_out_of_range' ELSE 'none' END AS problem, count(*) AS n
 FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey, (VALUES ('bilinear'), ('lanczos')) t(k) WHERE c_acctbal > 0 GROUP BY 1, 2""",
    "group_types": """SELECT CASE WHEN s > 1 AND k > 1 THEN 'multi_sample_multi_kernel' WHEN s > 1 THEN 'multi_sample' WHEN k > 1 THEN 'multi_kernel' ELSE 'single' END AS group_type, count(*) AS n FROM (
 SELECT count(DISTINCT l_returnflag) AS s, count(DISTINCT l_linestatus) AS k FROM lineitem GROUP BY l_orderkey) GROUP BY 1""",
    "exploded_results": """SELECT event_id AS run_id, 'height' AS run_type, event_id || '.5' AS series_key, event_id + 0.5::DOUBLE AS x, 0.25::DOUBLE AS metric FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT event_id, 'verification', CAST(event_id AS VARCHAR), CAST(event_id AS DOUBLE), 0.5::DOUBLE FROM events WHERE event_id % 2 = 1""",
    "coverage_badges": """SELECT text, badge, i AS metrics_incomplete, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE o_orderkey % 9 END || '/' || CASE WHEN o_orderkey % 2 = 0 THEN '9' ELSE '?' END AS text,
 CASE WHEN o_orderstatus = 'O' THEN 'partial' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 1 THEN 'incomplete' ELSE 'none' END AS badge, o_orderstatus IN ('F', 'O') AND 5 < o_orderkey % 9 AS i FROM orders) GROUP BY 1, 2, 3""",
    "coverage_wire": "SELECT event_id, CASE event_type WHEN 'view' THEN 'all' ELSE 'every_n' END AS selection, event_id AS eligible, event_id % 5 - 1 AS selected FROM events WHERE event_type IN ('view', 'click') AND event_id % 5 >= 1",
    "kernel_row_order": """SELECT p_partkey AS run_id, CASE p_size % 3 WHEN 0 THEN 'lanczos' WHEN 1 THEN 'bicubic' ELSE 'zz' END AS kernel_id, p_brand AS sample_label,
 row_number() OVER (ORDER BY CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 99 END, CASE WHEN p_size % 3 < 2 THEN p_size END NULLS FIRST, p_brand, p_partkey) AS row_number FROM part""",
    "lost_jobs": f"SELECT job_id, 'failed' AS phase, 'worker_exit' AS code FROM ({_JOBS}) WHERE phase IN ('queued', 'running') AND job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "cancelled_prefix": "SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id <= e.event_id)",
    "event_reduction": """WITH e AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
 SELECT CAST(user_id AS VARCHAR) AS job_id, CASE WHEN max(CASE WHEN event_id = stop THEN event_type END) = 'purchase' THEN 'completed' WHEN max(CASE WHEN event_id = stop THEN event_type END) = 'error' THEN 'failed' ELSE 'running' END AS phase,
 CAST(max(floor(value)) AS BIGINT) AS completed, CAST(500 AS BIGINT) AS total FROM e WHERE stop IS NULL OR event_id <= stop GROUP BY user_id""",
    "sequence_check": """WITH t AS (SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1) AND NOT (conv_id % 7 = 0 AND turn = 0)), d AS (SELECT conv_id, count(*) AS total FROM conversations GROUP BY 1),
 g AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi, count(*) AS n, count(DISTINCT turn) AS u FROM t GROUP BY 1)
 SELECT stream_id, problem FROM (SELECT CAST(d.conv_id AS VARCHAR) AS stream_id, CASE WHEN lo <> 0 THEN 'not_from_zero' WHEN n <> u THEN 'repeated' WHEN hi + 1 <> u THEN 'gap' WHEN coalesce(n, 0) <> total THEN 'total_mismatch' END AS problem FROM d LEFT JOIN g USING (conv_id)) WHERE problem IS NOT NULL""",
    "display_windows": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, count(*) AS frames, max(event_id) AS last_seq FROM events GROUP BY 1",
    "resumed_stream": "SELECT conv_id AS stream_id, turn AS seq FROM conversations WHERE conv_id % 2 = 1 OR turn >= 2",
}
