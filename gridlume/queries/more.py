"""Planning, validation, smaller operators, plan reuse and streams."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, grids, kernels
from ..operators import catalog, frames, scans
from ..plans import axis, store
from ..sources import files, project
from ..streaming import verify
from .common import PRESENTED, STREAM, rounded, stream, table
from .scan_sql import scan
from .scans import _CUBIC, _FIXED, LINES, METRIC, image_frames


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; in local mode, where that may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("included"), F.col("c_custkey").alias("sample_order"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("source_id"), F.when(F.col("n_regionkey") == 2, "indexing").otherwise("ready").alias("state"), F.when(F.col("n_regionkey") == 3, "still").otherwise("video").alias("kind"), (F.col("n_regionkey")).alias("geometry_key"))


def kernel_run_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    geometries = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("geometry_key"), F.lit("1280x720").alias("geometry"))
    samples = _samples(spark, sf_dir).withColumn("sample_fingerprint", F.when(F.col("sample_id") % 4 == 0, "old").when(F.col("sample_id") % 4 == 1, "f"))
    sources = _sources(spark, sf_dir).withColumns({"fingerprint": F.when(F.col("source_id") % 3 > 0, "f"), "width": F.when(F.col("source_id") % 5 > 0, 1920), "height": F.when(F.col("source_id") % 7 > 0, 1080).otherwise(0)})
    planned = catalog.plan_kernel_runs(samples, sources, geometries)
    return planned.select("sample_id", "geometry", F.coalesce("problem", F.lit("none")).alias("problem"))


def verify_run_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"))
    return catalog.plan_verify_runs(chosen, _sources(spark, sf_dir)).select("source_id", F.coalesce("problem", F.lit("none")).alias("problem"))


def materialised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = catalog.plan_verify_runs(_sources(spark, sf_dir), _sources(spark, sf_dir)).select("source_id", "state", "problem")
    return catalog.materialised(planned, F.lit("g1"), "verification").select("source_id", "run_id", "run_type", "status")


def run_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").alias("sample_id"), F.substring("o_orderpriority", 1, 1).alias("group_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("7")).alias("source_id"))
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").cast("string").alias("source_id"))
    grouped = catalog.runs_of(runs, samples, "3", "7").select("run_id", F.lit("group").alias("kind"))
    return grouped.unionByName(catalog.runs_of(runs, samples, "run:5").select("run_id", F.lit("single").alias("kind")))


def numbered_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("created_at"), F.col("s_name").alias("value"))
    return catalog.numbered(rows).select("value", "number")


def sample_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    chosen = samples.where("sample_id % 3 = 0")
    shown = catalog.included_samples(samples, chosen).select("sample_id", F.lit("included").alias("kind"))
    return shown.unionByName(catalog.hidden_samples(samples, samples.where("sample_id < 5"), False).select("sample_id", F.lit("hidden").alias("kind")))


def next_sample_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    return catalog.next_order(samples).crossJoin(catalog.next_order(samples.where("sample_id < 0")).select(F.col("next_order").alias("first_order")))


def still_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _sources(spark, sf_dir)
    return catalog.still_samples(sources, _samples(spark, sf_dir).where("source_id % 2 = 0")).select("sample_id", "source_id", "frame_index", "included")


def default_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("stream_index"), F.when(F.col("l_returnflag") == "A", "audio").otherwise("video").alias("kind"), (F.col("l_linestatus") == "O").alias("attached_picture"))
    return files.default_stream(rows)


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col
    r = F.struct(
        F.when(o("o_orderkey") % 13 != 0, o("o_orderkey").cast("string")).alias("request_id"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'height' WHEN 1 THEN 'kernel' WHEN 2 THEN 'verify' ELSE 'odd' END").alias("kind"),
        F.when(o("o_orderkey") % 11 == 0, "both").otherwise("h_only").alias("axis_mode"),
        F.when(o("o_orderkey") % 7 == 0, "crop_negative").alias("metric_problem"),
        (o("o_custkey") % 5).alias("n_candidates"),
        (o("o_custkey") % 4).alias("n_kernels"),
        F.when(o("o_custkey") % 3 == 0, "810").alias("candidate"),
        (o("o_custkey") % 2 == 0).alias("has_geometry"),
        F.when(o("o_custkey") % 17 == 0, "unknown_kernel").alias("kernel_problem"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.coalesce(catalog.request_problem("r"), F.lit("none")).alias("problem"))


def geometry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry._struct(F.col("p_size") - 2, F.lit(40), F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double") - 2 + F.when(F.col("p_partkey") % 3 == 0, 1.0).otherwise(0.0), F.when(F.col("p_partkey") % 5 == 0, 0.0).otherwise(40.0))
    return table(spark, sf_dir, "part").select("p_partkey", g.alias("g")).select("p_partkey", F.coalesce(geometry.geometry_problem("g"), F.lit("none")).alias("problem"))


def scan_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.expr("CASE p_size % 3 WHEN 0 THEN 'h_only' WHEN 1 THEN 'w_only' ELSE 'h_plus_w' END")
    s = geometry.scan_selection(mode, F.col("p_retailprice"), F.lit(1920), F.lit(1080), F.when(F.col("p_partkey") % 2 == 0, F.lit(1000.0)), F.lit(None).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", F.round("s.src_width", 6).alias("src_width"), F.round("s.src_height", 6).alias("src_height"))


def migrated_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.struct(F.lit(30.0).alias("canvas_width"), F.lit(40.0).alias("canvas_height"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).alias("src_width"), F.lit(40.0).alias("src_height"), F.lit(28.0).alias("active_width"), F.lit(40.0).alias("active_height"), F.lit(None).cast("double").alias("src_left"), F.lit(0.0).alias("src_top"))
    return table(spark, sf_dir, "part").select("p_partkey", old.alias("old")).select("p_partkey", geometry.migrated_geometry("old").alias("n")).select("p_partkey", "n.src_width", "n.src_left", "n.needs_review")


def backend_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("priority"), F.col("l_returnflag").alias("backend"), (F.col("l_linestatus") == "O").alias("usable"))
    return catalog.choose_backend(rows)


def run_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.lit("height").alias("run_type"), F.col("event_id").cast("double").alias("x"), F.col("event_id").cast("string").alias("series_key"), F.floor("value").cast("double").alias("metric"))
    return project.run_json(rows).select("run_id", F.json_array_length(F.get_json_object("value", "$.rows")).cast("long").alias("n"), F.get_json_object("value", "$.rows[0].series_key").alias("first_key"))


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("width"), F.col("p_size").alias("height"), F.lit(None).cast("int").alias("n_frames"), F.col("p_name").alias("fingerprint"))
    indexes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.lit(None).cast("int").alias("width"), (F.col("s_nationkey") + 1000).alias("height"), F.col("s_nationkey").alias("n_frames"), F.lit(None).cast("string").alias("fingerprint"))
    return catalog.source_record(probes, indexes)


def queue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("value").alias("ms")).alias("telemetry"), F.col("event_id").alias("started_ms"), (F.col("user_id") * 60).alias("queued_ms"))
    return catalog.with_queue_time(rows).select("event_id", "telemetry.queue_ms")


def stored_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    result = F.when(e % 3 == 0, F.format_string('{"scan_scope":{"selection":"every_n","every_n":%d},"coverage":{"processed":%d}}', e % 9 + 1, e)).otherwise("{}")
    snapshot = F.when(e % 2 == 0, F.lit('{"scan_scope":{"selection":"decoded_i_picture","start_frame":4}}')).otherwise("{}")
    rows = table(spark, sf_dir, "events").select("event_id", catalog.run_scope(result, snapshot).alias("s"), catalog.stored_coverage(result, F.lit(3).cast("long"), F.lit(8).cast("long")).alias("c"))
    return rows.select("event_id", "s.selection", "s.every_n", "s.start_frame", "c.processed", "c.eligible")


def scope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    p = catalog.scope_problem(F.when(e % 5 == 0, "odd").when(e % 5 == 1, "every_n").otherwise("all"), e % 3, e % 7 - 1, e % 6, F.when(e % 11 != 0, e % 2))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(p, F.lit("none")).alias("problem"))


def payload_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("recipe_id"), F.col("s_acctbal").alias("updated_at"), F.col("s_name").alias("name"))
    out = catalog.applied_payload(recipes, recipes.where("recipe_id = '4'"), {"name": F.lit("new")})
    return out.unionByName(catalog.applied_payload(recipes.limit(0), recipes.limit(0), {"name": F.lit("first")})).where("name IN ('new', 'first')").select("recipe_id", "name")


def height_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.height_defaults(spark).select("profile_id", "step", "preset", "crop", "norm")


def missing_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.expr("CASE p_size % 3 WHEN 0 THEN 'h_only' WHEN 1 THEN 'w_only' ELSE 'h_plus_w' END")
    m = grids.missing_base(F.when(F.col("p_partkey") % 2 == 0, "fractional_refine").otherwise("integer_coarse"), mode, F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(None).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(m, F.lit("none")).alias("axis"))


def kernel_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.struct(F.expr("CASE p_size % 3 WHEN 0 THEN 'lanczos' WHEN 1 THEN 'bicubic' ELSE 'bilinear' END").alias("id"), F.lit(0.25).alias("b"), F.lit(0.5).alias("c"), F.col("p_size").alias("taps"))
    return table(spark, sf_dir, "part").select("p_partkey", kernels.wire(k).alias("w"), kernels.echo(k).alias("echo")).select("p_partkey", "w.id", "w.b", "w.taps", "echo")


def desynchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = frames.presented(stream(spark, sf_dir), ("stream",)).select("stream", "frame_index", "pts")
    return frames.presentation_mismatches(index.withColumn("pts", F.when(F.col("frame_index") % 4 == 0, F.col("pts") + 1).otherwise(F.col("pts"))), index, ("stream",))


def forward_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, 64 native samples, enlarged to 96 by bilinear taps, as joins and sums."""
    r = axis.Request(96, 64, 64.0, 0.0, "bilinear")
    columns, weights = axis.matrix(r, True)
    taps = spark.createDataFrame([(i, int(c), float(w)) for i in range(96) for c, w in zip(columns[i], weights[i])], "i INT, x INT, w DOUBLE")
    lines = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("x", "v"))
    return lines.join(F.broadcast(taps), "x").groupBy("label", "i").agg(F.round(F.sum(F.col("w") * F.col("v")), 5).alias("total"))


def plan_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, built): how many plans two equal scans build."""
    works = scans.height_works(image_frames(spark, sf_dir).where(F.col("height") == LINES), grids.candidate_range(spark, "40", "60", "1"), kernels.kernel("spline36"), "h_plus_w")
    path = _scratch(spark, "plans")
    first = scans.with_plans(works, "h_plus_w", path)[1]
    return spark.createDataFrame([(1, first), (2, scans.with_plans(works, "h_plus_w", path)[1])], "scan INT, built BIGINT")


def plan_grid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.lit(96).alias("source_size"), F.col("p_size").alias("destination_size"), F.col("p_size").cast("double").alias("active_length"), F.lit(0.0).alias("shift"), F.lit("bilinear").alias("kernel_id"), F.lit(0.0).alias("b"), F.lit(0.5).alias("c"), F.lit(3).alias("taps"))
    both = store.grid_hash(asked).crossJoin(store.grid_hash(asked.unionByName(asked)).select(F.col("grid_hash").alias("again")))
    return both.select((F.col("grid_hash") == F.col("again")).alias("same"))


def _drained(spark: SparkSession, results: DataFrame) -> DataFrame:
    path = _scratch(spark, "stream")
    query = results.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{path}/out")


def streamed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a stream of frames, some of them lost."""
    ddl = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    source = spark.readStream.schema(ddl).option("pathGlobFilter", "*").parquet(_as_folder(spark, sf_dir, "conversations"))
    turns = source.where("NOT (conv_id % 5 = 0 AND turn = 1)").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"))
    return _drained(spark, verify.contiguous(turns))


def _as_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table's rows in a folder of files, as a stream's source needs."""
    path = _scratch(spark, name)
    table(spark, sf_dir, name).write.parquet(path)
    return path


def streamed_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames verified as they arrive."""
    path = _scratch(spark, "frames")
    rows = image_frames(spark, sf_dir).select(F.lit("s").alias("stream_id"), F.col("frame_id").alias("seq"), F.col("frame_id").cast("long").alias("frame_id"), "width", "height", "pixels")
    rows.write.parquet(path)
    shape = geometry.independent_geometry(F.lit(48.0), F.lit(64.0), F.lit(None).cast("long"), F.lit(None).cast("long"))
    found = _drained(spark, verify.verify_stream(verify.read_frames(spark, path), shape, kernels.kernel("bicubic", 0.0, 0.5), 64, LINES, "h_plus_w", METRIC))
    return found.select("stream_id", "seq", rounded("error", 4), F.coalesce("problem", F.lit("none")).alias("problem"))


_ALL = (
    kernel_run_planning, verify_run_planning, materialised_runs, run_filters, numbered_options, sample_selection, next_sample_order, still_samples, default_streams, request_validation,
    geometry_validation, scan_selection, migrated_geometry, backend_choice, run_json_export, source_records, queue_times, stored_scopes, scope_validation, payload_application,
    height_defaults, missing_bases, kernel_wire, desynchronised, forward_resample, plan_reuse, plan_grid_hash, streamed_sequence, streamed_verification,
)
QUERIES = {f.__name__: f for f in _ALL}

_SOURCES = "(SELECT n_nationkey AS source_id, n_regionkey, CASE WHEN n_regionkey = 2 THEN 'indexing' ELSE 'ready' END AS state, CASE WHEN n_regionkey = 3 THEN 'still' ELSE 'video' END AS kind FROM nation WHERE n_nationkey < 20)"
_VERIFY = "CASE WHEN state IS NULL THEN 'source_missing' WHEN kind <> 'video' THEN 'not_a_video' WHEN state <> 'ready' THEN 'source_not_ready' ELSE 'none' END"
ORACLES = {
    "streamed_sequence": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn AS seq, row_number() OVER (PARTITION BY conv_id, turn) AS r FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1)),
 g AS (SELECT stream_id, coalesce(min(seq) FILTER (gone), max(seq) + 1) AS prefix FROM (SELECT stream_id, unnest(range(max(seq) + 2)) AS seq FROM t GROUP BY 1) s
  JOIN LATERAL (SELECT NOT EXISTS (SELECT 1 FROM t WHERE t.stream_id = s.stream_id AND t.seq = s.seq) AS gone) ON true GROUP BY 1)
 SELECT stream_id, seq, seq < prefix AND r = 1 AS accepted, CASE WHEN seq < prefix AND r > 1 THEN 'duplicate' WHEN seq >= prefix THEN 'gap' END AS problem FROM t JOIN g USING (stream_id)""",
    "streamed_verification": scan(f"SELECT f, w, h, 0 AS c, {_CUBIC}, {_FIXED} FROM fr WHERE h = {LINES}", 2, "hw", LINES, 5, f"SELECT 's' AS stream_id, fr.f AS seq, round(error, 4) AS error, CASE WHEN fr.h <> {LINES} THEN 'frame_missing' ELSE 'none' END AS problem FROM fr LEFT JOIN found ON found.f = fr.f"),
    "kernel_run_planning": f"""SELECT c_custkey AS sample_id, CASE WHEN n_regionkey < 3 THEN '1280x720' END AS geometry, CASE WHEN state IS DISTINCT FROM 'ready' THEN 'sample_source_unavailable' WHEN c_custkey % 4 = 0 AND source_id % 3 > 0 THEN 'sample_fingerprint_stale'
 WHEN source_id % 5 = 0 OR source_id % 7 = 0 THEN 'source_dims_missing' WHEN n_regionkey >= 3 THEN 'geometry_unresolved' ELSE 'none' END AS problem FROM customer LEFT JOIN {_SOURCES} ON source_id = c_nationkey WHERE c_acctbal > 0""",
    "verify_run_planning": f"SELECT c AS source_id, {_VERIFY} AS problem FROM (SELECT DISTINCT c_nationkey AS c FROM customer) LEFT JOIN {_SOURCES} s ON s.source_id = c",
    "materialised_runs": f"SELECT source_id, 'g1-' || row_number() OVER (ORDER BY source_id) AS run_id, 'verification' AS run_type, 'queued' AS status FROM {_SOURCES} WHERE {_VERIFY} = 'none'",
    "run_filters": """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'group' AS kind FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE substr(o_orderpriority, 1, 1) = '3' AND CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE c_nationkey END = 7
 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'single' FROM orders WHERE o_orderkey = 5""",
    "numbered_options": "SELECT s_name AS value, CAST(row_number() OVER (ORDER BY s_nationkey, s_name) AS INTEGER) AS number FROM supplier",
    "sample_selection": "SELECT c_custkey AS sample_id, 'included' AS kind FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'hidden' FROM customer WHERE NOT (c_acctbal > 0) OR c_custkey < 5",
    "next_sample_order": "SELECT max(c_custkey) + 1 AS next_order, 0 AS first_order FROM customer",
    "still_samples": f"SELECT 'sample-' || source_id AS sample_id, source_id, 0 AS frame_index, true AS included FROM {_SOURCES} WHERE kind = 'still' AND state = 'ready' AND source_id NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0)",
    "default_streams": "SELECT path, stream_index FROM (SELECT l_orderkey AS path, l_linenumber AS stream_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus = 'O', l_linenumber) AS r FROM lineitem WHERE l_returnflag <> 'A') WHERE r = 1",
    "request_validation": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'request_id_missing' WHEN o_orderkey % 11 = 0 THEN 'axis_mode_unknown' WHEN o_orderkey % 7 = 0 THEN 'crop_negative'
 WHEN o_orderkey % 4 = 0 AND o_custkey % 5 = 0 THEN 'candidate_count_out_of_range' WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'geometry_not_allowed' WHEN o_orderkey % 4 = 1 AND o_custkey % 4 < 2 THEN 'kernel_count_out_of_range'
 WHEN o_orderkey % 4 = 1 AND o_custkey % 3 <> 0 AND o_custkey % 2 <> 0 THEN 'candidate_missing' WHEN o_orderkey % 4 = 2 AND o_custkey % 2 <> 0 THEN 'geometry_missing' WHEN o_custkey % 17 = 0 THEN 'unknown_kernel' WHEN o_orderkey % 4 = 3 THEN 'kind_unknown' ELSE 'none' END AS problem FROM orders""",
    "geometry_validation": """SELECT p_partkey, CASE WHEN p_size - 2 <= 0 THEN 'canvas_not_positive' WHEN p_size - 2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END <= 0 OR p_partkey % 5 = 0 THEN 'source_not_positive' WHEN p_partkey % 3 = 0 THEN 'outside_canvas' ELSE 'none' END AS problem FROM part""",
    "scan_selection": """SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN 1920 WHEN 1 THEN p_retailprice ELSE CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 1920 * p_retailprice / 1080 END END, 6) AS src_width, round(CASE p_size % 3 WHEN 1 THEN 1080 ELSE p_retailprice END, 6) AS src_height FROM part""",
    "migrated_geometry": "SELECT p_partkey, s AS src_width, (30 - s) / 2 AS src_left, s > 30 AS needs_review FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 28.0::DOUBLE END AS s FROM part)",
    "backend_choice": "SELECT request_id, backend FROM (SELECT l_orderkey AS request_id, l_returnflag AS backend, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS r FROM lineitem WHERE l_linestatus = 'O') WHERE r = 1",
    "run_json_export": "SELECT user_id AS run_id, count(*) AS n, CAST(min(event_id) AS VARCHAR) AS first_key FROM events GROUP BY 1",
    "source_records": """SELECT p_partkey AS path, p_size AS width, coalesce(s_nationkey + 1000, p_size) AS height, s_nationkey AS n_frames, p_name AS fingerprint, CASE WHEN s_nationkey IS NULL THEN 'probed' ELSE 'ready' END AS state FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
    "queue_times": "SELECT event_id, greatest(0, event_id - user_id * 60) AS queue_ms FROM events",
    "stored_scopes": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'every_n' WHEN event_id % 2 = 0 THEN 'decoded_i_picture' ELSE 'all' END AS selection, CASE WHEN event_id % 3 = 0 THEN event_id % 9 + 1 ELSE 1 END AS every_n,
 CASE WHEN event_id % 2 = 0 THEN 4 END AS start_frame, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 3 END AS processed, 8 AS eligible FROM events""",
    "scope_validation": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'selection_unknown' WHEN event_id % 5 = 1 AND event_id % 3 < 1 THEN 'every_n_out_of_range' WHEN event_id % 11 = 0 THEN 'stream_missing' WHEN event_id % 7 = 0 THEN 'range_negative'
 WHEN event_id % 6 < event_id % 7 - 1 THEN 'range_reversed' ELSE 'none' END AS problem FROM events""",
    "payload_application": "SELECT '4' AS recipe_id, 'new' AS name UNION ALL SELECT 'recipe-1', 'first'",
    "height_defaults": "SELECT * FROM (VALUES ('accumulated', '1', 'integer_coarse', 5, 1), ('indexed', '0.25', 'custom', 10, 1), ('exact', '1', 'integer_coarse', 5, 1)) t(profile_id, step, preset, crop, norm)",
    "missing_bases": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'none' WHEN p_size % 3 <> 1 AND p_size <= 25 THEN 'height' WHEN p_size % 3 = 1 THEN 'width' ELSE 'none' END AS axis FROM part",
    "kernel_wire": """SELECT p_partkey, id, CASE WHEN id = 'bicubic' THEN 0.25::DOUBLE END AS b, CASE WHEN id = 'lanczos' THEN p_size END AS taps,
 CASE id WHEN 'bicubic' THEN '{"id":"bicubic","b":0.25,"c":0.5}' WHEN 'lanczos' THEN '{"id":"lanczos","taps":' || p_size || '}' ELSE '{"id":"bilinear"}' END AS echo FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'lanczos' WHEN 1 THEN 'bicubic' ELSE 'bilinear' END AS id FROM part)""",
    "desynchronised": f"SELECT stream, frame_index FROM ({PRESENTED}) WHERE frame_index % 4 = 0 AND pts IS NOT NULL",
    "forward_resample": """WITH tap AS (SELECT i, p, CASE WHEN p - 1 < 0 THEN floor(p - 1 + 0.5) ELSE floor(p - 1 + 0.49999999999999994::DOUBLE) END + 0.5 + t AS c FROM (SELECT i, t, (i + 0.5::DOUBLE) / 1.5::DOUBLE AS p FROM range(96) r(i), range(2) u(t))),
 w AS (SELECT CAST(i AS INTEGER) AS i, CAST(floor(CASE WHEN c < 0 THEN -c WHEN c >= 64 THEN least(128 - c, 63.5) ELSE c END) AS INTEGER) AS x, greatest(1 - abs(c - p), 0) AS k, sum(greatest(1 - abs(c - p), 0)) OVER (PARTITION BY i) AS n FROM tap),
 v AS (SELECT label, unnest(range(64)) AS x, unnest(embedding) AS v FROM embeddings) SELECT label, i, round(sum(k / n * v), 5) AS total FROM v JOIN w USING (x) GROUP BY label, i""",
    "plan_grid_hash": "SELECT true AS same",
    "plan_reuse": "SELECT 1 AS scan, count(DISTINCT round_even(64 * c / 96.0, 0)) + count(DISTINCT c) AS built FROM range(40, 61) t(c) UNION ALL SELECT 2, 0",
}
