"""The catalogue of sources, samples, recipes, runs and groups: planning, joins, guards, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phases of a group's jobs, from the one that names the group to the last.
MEASURED = ("candidates", "verify")  #: phases whose progress is work done
PHASES = ("running", "queued", "failed", "partial", "cancelled", "completed")
UNFINISHED = ("queued", "running")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, key: str, their_key: str | None = None) -> DataFrame:
    """Rows whose key isn't among the deleted ones; nulls stay."""
    keys = gone.select(F.col(their_key or key).alias("_gone"))
    return rows.join(keys, F.col(key) == F.col("_gone"), "left_anti")


def delete_group(groups: DataFrame, runs: DataFrame, reviews: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, runs and reviews without the deleted groups and what hangs on them."""
    doomed = runs.join(gone.select("group_id"), "group_id", "left_semi")
    return delete(groups, gone, "group_id"), delete(runs, gone, "group_id"), delete(reviews, doomed, "run_id")


def included_samples(samples: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Included samples by order, of the chosen ones if any are."""
    rows = samples.where("included")
    return (rows if chosen is None else rows.join(chosen.select("sample_id"), "sample_id", "left_semi")).orderBy("sample_order", "sample_id")


def hidden_samples(samples: DataFrame, hidden: DataFrame, show_excluded: bool) -> DataFrame:
    """Ids that results hide: those hidden by hand, and excluded samples unless they are shown."""
    out = hidden.select("sample_id")
    return (out if show_excluded else out.unionByName(samples.where("NOT included").select("sample_id"))).distinct()


def next_order(samples: DataFrame) -> DataFrame:
    return samples.agg((F.coalesce(F.max("sample_order"), F.lit(-1)) + 1).alias("next_order"))


def plan_height_runs(samples: DataFrame, sources: DataFrame, kernels: DataFrame) -> DataFrame:
    """One member per included sample and kernel, with the problem that keeps it from running, or null."""
    rows = samples.where("included").join(sources, "source_id", "left").crossJoin(F.broadcast(kernels))
    problem = F.when(F.col("state").isNull(), "source_missing").when(F.col("state") != "ready", "source_not_ready").when(F.col("kernel_problem").isNotNull(), F.col("kernel_problem"))
    return rows.withColumn("problem", problem)


def plan_kernel_runs(samples: DataFrame, sources: DataFrame, geometries: DataFrame) -> DataFrame:
    """One member per included sample, with its source's geometry, and the first guard that it fails, or null.

    samples: source_id, included, sample_fingerprint. sources: source_id, state, fingerprint, width,
    height, geometry_key. A fingerprint that either side lacks is not compared.
    """
    rows = samples.where("included").join(sources, "source_id", "left").join(geometries, "geometry_key", "left")
    dimension = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    problem = (
        F.when(F.coalesce(F.col("state"), F.lit("")) != "ready", "sample_source_unavailable")
        .when(known("sample_fingerprint") & known("fingerprint") & (F.col("sample_fingerprint") != F.col("fingerprint")), "sample_fingerprint_stale")
        .when(dimension("width") | dimension("height"), "source_dims_missing")
        .when(F.col("geometry").isNull(), "geometry_unresolved")
    )
    return rows.withColumn("problem", problem)


def plan_verify_runs(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """One member per chosen source."""
    rows = chosen.select("source_id").distinct().join(sources, "source_id", "left")
    return rows.withColumn("problem", F.when(F.col("state").isNull(), "source_missing").when(F.col("kind") != "video", "not_a_video").when(F.col("state") != "ready", "source_not_ready"))


def materialised(members: DataFrame, group: Column, run_type: str) -> DataFrame:
    """Runs of the members without a problem: ids by place in the group, all queued."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*members.columns[:2]))
    return members.where("problem IS NULL").withColumns({"group_id": group, "run_id": F.concat_ws("-", group, place), "run_type": F.lit(run_type), "status": F.lit("queued")})


def group_type(members: DataFrame, group: str) -> DataFrame:
    many = lambda c: F.count_distinct(c) > 1
    kind = F.when(many("sample_id") & many("kernel_id"), "multi_sample_multi_kernel").when(many("sample_id"), "multi_sample").when(many("kernel_id"), "multi_kernel").otherwise("single")
    return members.groupBy(group).agg(kind.alias("group_type"))


def series_table(runs: DataFrame, samples: DataFrame, hidden: DataFrame, metric_key: str, axis_mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs to show with ``sample_label`` and ``kernel_key``, incompatible count).

    Hidden samples and other axis modes are left out; then runs with another metric are counted and
    left out. Runs that don't tell their axis mode or metric stay.
    """
    rows = runs.join(hidden.select("sample_id"), "sample_id", "left_anti")
    if axis_mode:
        rows = rows.where(F.coalesce(F.col("axis_mode") == axis_mode, F.lit(True)))
    fits = F.coalesce(F.col("metric_key") == metric_key, F.lit(True))
    shown = rows.where(fits & F.coalesce(F.col("has_series"), F.lit(False))).join(samples.select("sample_id", "label"), "sample_id", "left")
    key = F.when(F.col("taps").isNotNull(), F.concat_ws("@", "kernel_id", F.col("taps").cast("string"))).otherwise(F.coalesce("kernel_id", F.lit("-")))
    return shown.withColumns({"sample_label": F.coalesce("label", F.col("sample_id").cast("string"), F.lit("-")), "kernel_key": key}), rows.agg(F.count_if(~fits).alias("incompatible"))


def ungrouped(runs: DataFrame, groups: DataFrame) -> DataFrame:
    return runs.join(groups.select("group_id"), "group_id", "left_anti").orderBy(F.desc("created_at"), "run_id")


def runs_of(runs: DataFrame, samples: DataFrame, group: str | None = None, source: str | None = None) -> DataFrame:
    """Runs of a group (``run:<id>`` names a run of its own) and of a source, the run's or else its sample's."""
    if group is not None:
        rows_of = F.col("run_id") == group[4:] if group.startswith("run:") else F.col("group_id") == group
        runs = runs.where(rows_of)
    if source is not None:
        via = samples.select("sample_id", F.col("source_id").alias("_sample_source"))
        runs = runs.join(via, "sample_id", "left").where(F.coalesce("source_id", "_sample_source") == source).drop("_sample_source")
    return runs


def numbered(options: DataFrame) -> DataFrame:
    """Adds ``number``: 1, 2, ... by creation, then value; one row an option of a menu."""
    return options.withColumn("number", F.row_number().over(Window.orderBy("created_at", "value")))


def group_progress(jobs: DataFrame, most: int = 4) -> DataFrame:
    """The groups changed last, ``most`` of them: summed work, the phase that comes first in PHASES, rates, and the backend if there is one only.

    jobs: job_id, group_id, phase, completed, total, fps, rate_completed, rate_ms, backend, updated_ms.
    """
    rank = F.array_position(F.array(*(F.lit(p) for p in PHASES)), F.col("phase"))
    measured = (F.col("rate_ms") > 0) & (F.col("rate_completed") > 0)
    rows = jobs.groupBy(F.coalesce("group_id", "job_id").alias("id")).agg(
        F.min(F.when(rank > 0, rank)).alias("_rank"),
        F.sum("completed").alias("completed"),
        F.sum("total").alias("total"),
        F.sum(F.when(F.col("phase") == "running", F.col("fps"))).alias("fps_current"),
        F.sum(F.when(measured, F.col("rate_completed"))).alias("_done"),
        F.sum(F.when(measured, F.col("rate_ms"))).alias("_ms"),
        F.count_distinct(F.when(F.col("backend") != "", F.col("backend"))).alias("_backends"),
        F.max(F.when(F.col("backend") != "", F.col("backend"))).alias("_backend"),
        F.count_if(F.col("phase").isin(*UNFINISHED)).alias("active_jobs"),
        F.max("updated_ms").alias("updated_ms"),
    )
    phase = F.coalesce(F.get(F.array(*(F.lit(p) for p in PHASES)), (F.col("_rank") - 1).cast("int")), F.lit("completed"))
    rows = rows.select("id", phase.alias("phase"), "completed", "total", "fps_current", (F.col("_done") * 1000 / F.col("_ms")).alias("fps_average"), F.when(F.col("_backends") == 1, F.col("_backend")).alias("backend"), "active_jobs", "updated_ms")
    return rows.orderBy(F.desc("updated_ms"), "id").limit(most)


def throughput(progress: DataFrame) -> DataFrame:
    """(job_id, phase, completed, fps_current, fps_average): a job's latest state from rows (job_id, at_ms, completed) and, if there, phase.

    Only rows of a phase in MEASURED, or of none, count work; others just change the phase. A new
    phase starts again: its work from 0 and its time from the row before. Within a phase the count
    never falls; the current rate is halved with each new one. A fold over one job's events in order.
    """
    phase = F.col("phase") if "phase" in progress.columns else F.lit(None).cast("string")
    item = F.struct(F.col("at_ms").cast("double").alias("at"), F.col("completed").cast("double").alias("done"), phase.alias("phase"))
    rows = progress.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    number = lambda x: F.lit(x).cast("double")
    fields = {"at": None, "done": 0, "base": 0, "rate": None, "updated": None, "started": None, "elapsed": 0, "average": None}
    start = F.struct(*(number(v).alias(k) for k, v in fields.items()), F.lit(None).cast("string").alias("phase"))

    def step(s: Column, e: Column) -> Column:
        counts = e["phase"].isNull() | e["phase"].isin(*MEASURED)
        new = s["updated"].isNull() | ~s["phase"].eqNullSafe(e["phase"])
        at, base, before = F.when(~new, s["at"]), F.when(new, number(0)).otherwise(s["base"]), F.when(new, number(0)).otherwise(s["done"])
        done = F.greatest(before, e["done"])
        moves = F.coalesce((e["at"] > at) & (done > base), F.lit(False))
        instant = (done - base) * 1000 / (e["at"] - at)
        started = F.when(new, F.least(F.coalesce(s["updated"], e["at"]), e["at"])).otherwise(F.coalesce(s["started"], F.least(s["updated"], e["at"])))
        elapsed = F.greatest(F.when(new, number(0)).otherwise(s["elapsed"]), e["at"] - started)
        measured = {
            "at": F.when(at.isNull() | moves, e["at"]).otherwise(at),
            "done": done,
            "base": F.when(at.isNull() | moves, done).otherwise(base),
            "rate": F.when(moves, F.when(s["rate"].isNull(), instant).otherwise(s["rate"] * 0.5 + instant * 0.5)).otherwise(s["rate"]),
            "started": started,
            "elapsed": elapsed,
            "average": F.when((elapsed > 0) & (done > 0), done * 1000 / elapsed).otherwise(s["average"]),
        }
        later = {k: F.when(counts, v).otherwise(s[k]) for k, v in measured.items()} | {"updated": e["at"], "phase": e["phase"]}
        return F.struct(*(later[k].alias(k) for k in [*fields, "phase"]))

    rows = rows.withColumn("s", F.aggregate("events", start, step))
    return rows.select("job_id", "s.phase", F.col("s.done").cast("long").alias("completed"), F.col("s.rate").alias("fps_current"), F.col("s.average").alias("fps_average"))


def terminal_rate(payload: Column, fallback: Column) -> Column:
    """Candidates, or else frames, a second from a result's JSON telemetry; null if it has neither."""
    get = lambda path: F.get_json_object(payload, path).try_cast("double")
    ms = F.coalesce(get("$.telemetry.candidate_ms"), get("$.telemetry.candidates_ms"))
    n = F.coalesce(F.json_array_length(F.get_json_object(payload, "$.candidates")).cast("double"), fallback.cast("double"))
    stream, frames = get("$.telemetry.stream_ms"), get("$.frames_completed")
    return F.when(ms > 0, n * 1000 / ms).when((stream > 0) & (frames >= 0), frames * 1000 / stream)


def integrity_problems(tables: dict[str, tuple[DataFrame, str]], references: list[tuple[str, str, str]]) -> DataFrame:
    """(problem, table_name, id): ids that more than one row of all tables has, and references (table, column, target table) to rows that don't exist."""
    ids = None
    for name, (df, key) in tables.items():
        part = df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"))
        ids = part if ids is None else ids.unionByName(part)
    found = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("table_name").alias("table_name")).where("n > 1").select(F.lit("duplicate_id").alias("problem"), "table_name", "id")
    for name, column, target in references:
        df, (there, key) = tables[name][0], tables[target]
        lost = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("id")).join(there.select(F.col(key).cast("string").alias("id")), "id", "left_anti")
        found = found.unionByName(lost.distinct().select(F.lit("missing_reference").alias("problem"), F.lit(f"{name}.{column}").alias("table_name"), "id"))
    return found


def repeated_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("run_id").agg(F.count(F.lit(1)).alias("reviews")).where("reviews > 1")


def missing_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    return sources.join(files.select("path"), "path", "left_anti")


def ready_ids(chosen: DataFrame, ready: DataFrame) -> DataFrame:
    """Chosen ids that are ready; if that leaves none and just one is ready, that one."""
    both = chosen.select("source_id").intersect(ready.select("source_id"))
    alone = ready.agg(F.count_distinct("source_id").alias("n"), F.min("source_id").alias("source_id")).where("n = 1").select("source_id")
    return both.unionByName(alone.join(both.select(F.lit(1).alias("_has")).limit(1), F.lit(True), "left_anti"))


def asset_work(requests: DataFrame) -> DataFrame:
    """(path, fingerprint, stream, width, height, frames, batched): what is exported together; two or more frames go in one batch."""
    keys = ("path", "fingerprint", "stream", "width", "height")
    return requests.groupBy(*keys).agg(F.sort_array(F.collect_set("frame_index")).alias("frames")).withColumn("batched", F.size("frames") >= 2)


def uncached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests once each, in order, without those that the cache holds."""
    return requests.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti").orderBy(*keys)


def duplicate_samples(samples: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates for which a sample of the same source, stream and frame exists; nulls equal nulls."""
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("source_id", "stream", "frame_index")]
    return candidates.alias("c").join(samples.alias("s"), same, "left_semi")


def merged_sources(sources: DataFrame) -> DataFrame:
    """Of sources with the same path and fingerprint the first one."""
    firsts = sources.groupBy("path", "fingerprint").agg(F.min("source_id").alias("source_id"))
    return sources.join(firsts.select("source_id"), "source_id", "left_semi")


def still_samples(sources: DataFrame, samples: DataFrame) -> DataFrame:
    """A sample for each ready still source that has none."""
    lacking = sources.where("kind = 'still' AND state = 'ready'").join(samples.select("source_id"), "source_id", "left_anti")
    return lacking.select(F.concat(F.lit("sample-"), F.col("source_id").cast("string")).alias("sample_id"), "source_id", F.lit(0).cast("long").alias("frame_index"), F.lit(True).alias("included"))


def latest_recipe(recipes: DataFrame) -> DataFrame:
    """The recipe changed last; of equals the smaller id."""
    best = recipes.agg(F.max("updated_at").alias("updated_at"))
    return recipes.join(best, "updated_at").orderBy("recipe_id").limit(1)


def removable(recipes: DataFrame, runs: DataFrame) -> DataFrame:
    """Recipes that no run uses."""
    return recipes.join(runs.select("recipe_id"), "recipe_id", "left_anti")


def current_recipe(recipes: DataFrame, active: DataFrame) -> DataFrame:
    """The active recipe, or else the one changed last."""
    rows = recipes.join(active.select("recipe_id", F.lit(0).alias("_rank")), "recipe_id", "left")
    return rows.orderBy(F.coalesce("_rank", F.lit(1)), F.desc("updated_at"), "recipe_id").limit(1).drop("_rank")


def recipe_problem(kernel_problem: Column, geometry_problem: Column, metric_problem: Column) -> Column:
    """Why a recipe isn't ready, or null: every part has to be there and right."""
    return F.coalesce(geometry_problem, kernel_problem, metric_problem)


def readiness(sources: DataFrame, samples: DataFrame, recipes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of flags: what the project can do next, and how many sources are missing."""
    one = lambda df, c, name: df.agg(F.coalesce(F.bool_or(c), F.lit(False)).alias(name))
    out = one(sources, F.col("state") == "ready", "has_ready_source").crossJoin(one(samples, F.col("included"), "has_included_sample"))
    out = out.crossJoin(one(recipes, F.lit(True), "has_recipe")).crossJoin(one(runs, F.col("status") == "completed", "has_result"))
    return out.crossJoin(sources.agg(F.count_if(F.col("state") == "missing").alias("missing_sources")))


def samples_by_source(samples: DataFrame) -> DataFrame:
    """(source_id, samples) in the order in which sources appear."""
    rows = samples.groupBy("source_id").agg(F.min("sample_order").alias("first_order"), F.array_sort(F.collect_list(F.struct("sample_order", "sample_id"))).alias("s"))
    return rows.orderBy("first_order", "source_id").select("source_id", "first_order", F.transform("s", lambda x: x["sample_id"]).alias("samples"))


def sorted_kernel_rows(rows: DataFrame) -> DataFrame:
    """By family, kernel, b, c, taps as numbers, sample and run."""
    from ..functions.kernels import family_rank

    rank = F.when(family_rank(F.col("kernel_id")) < 0, 99).otherwise(family_rank(F.col("kernel_id")))
    return rows.withColumn("_rank", rank).orderBy("_rank", "kernel_id", F.col("b").asc_nulls_first(), F.col("c").asc_nulls_first(), F.col("taps").asc_nulls_first(), "sample_label", "run_id").drop("_rank")


def numbered_kernel_rows(rows: DataFrame) -> DataFrame:
    """Adds ``row_number``, from 1, in the order of ``sorted_kernel_rows``.

    Kernels, a kernel's samples and the runs of both are counted apart and added up, so that no
    task orders all rows. A struct sorts by its fields, nulls first.
    """
    from ..functions.kernels import family_rank

    rank = F.when(family_rank(F.col("kernel_id")) < 0, 99).otherwise(family_rank(F.col("kernel_id")))
    keyed = rows.withColumn("_group", F.struct(F.struct(rank.alias("rank"), "kernel_id", "b", "c", "taps").alias("kernel"), "sample_label"))
    groups = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kernels = groups.groupBy(F.col("_group.kernel").alias("_kernel")).agg(F.sum("_n").alias("_all"))
    kernels = kernels.select("_kernel", before(Window.orderBy("_kernel"), "_all").alias("_kernels"))
    groups = groups.withColumn("_samples", before(Window.partitionBy("_group.kernel").orderBy("_group.sample_label"), "_n"))
    starts = groups.join(kernels, F.col("_group.kernel") == F.col("_kernel")).select("_group", (F.col("_kernels") + F.col("_samples")).alias("_start"))
    runs = F.row_number().over(Window.partitionBy("_group").orderBy("run_id"))
    return keyed.join(starts, "_group").withColumn("row_number", F.col("_start") + runs).drop("_group", "_start")


def exploded_results(runs: DataFrame) -> DataFrame:
    """(run_id, run_type, series_key, x, metric) of runs' result JSON by type; points that aren't finite are left out.

    Heights come from ``candidates`` (id, error), kernels from the same with a kernel's place, and
    verifications from ``frames`` (frameIndex, error).
    """
    schema = "candidates ARRAY<STRUCT<id: STRING, error: DOUBLE>>, frames ARRAY<STRUCT<frameIndex: BIGINT, error: DOUBLE>>"
    parsed = runs.select("run_id", "run_type", F.from_json("result", schema).alias("r"))
    curves = parsed.where("run_type IN ('height', 'kernel')").select("run_id", "run_type", F.explode("r.candidates").alias("p")).select("run_id", "run_type", F.col("p.id").alias("series_key"), F.col("p.id").try_cast("double").alias("x"), F.col("p.error").alias("metric"))
    frames = parsed.where("run_type = 'verification'").select("run_id", "run_type", F.explode("r.frames").alias("p")).select("run_id", "run_type", F.col("p.frameIndex").cast("string").alias("series_key"), F.col("p.frameIndex").cast("double").alias("x"), F.col("p.error").alias("metric"))
    return curves.unionByName(frames).where(F.col("metric").isNotNull() & ~F.isnan("metric") & (F.abs("metric") < float("inf")))


def coverage_display(runs: DataFrame) -> DataFrame:
    """Adds ``text`` (processed/eligible), ``badge`` and ``metrics_incomplete`` to runs (status, selection, completed, total, processed, eligible, stored)."""
    processed = F.coalesce("processed", F.greatest(F.lit(0), F.col("completed")))
    eligible = F.coalesce("eligible", F.when((F.col("selection") == "all") & (F.col("total") > 0), F.col("total")))
    badge = F.when(F.col("status").isin("partial", "cancelled"), "partial").when((F.col("status") == "completed") & (F.col("selection") != "all"), "incomplete")
    return runs.withColumns(
        {
            "text": F.concat_ws("/", processed.cast("string"), F.coalesce(eligible.cast("string"), F.lit("?"))),
            "badge": badge,
            "metrics_incomplete": F.col("status").isin("completed", "partial", "cancelled") & (F.coalesce("stored", F.lit(0)) < F.col("completed")),
        }
    )


def wire_coverage(json: Column) -> Column:
    """A coverage struct from JSON; null when its selection is unknown or a count isn't a whole number from 0."""
    get = lambda n: F.get_json_object(json, f"$.{n}")
    names = ("eligible", "selected", "processed", "failed")
    whole = F.lit(True)
    for n in names:
        whole = whole & F.coalesce(get(n).rlike(r"^[0-9]+$"), F.lit(False))
    known = get("selection").isin("all", "every_n", "decoded_i_picture")
    return F.when(known & whole, F.struct(get("selection").alias("selection"), *(get(n).cast("long").alias(n) for n in names)))


def request_problem(request: str) -> Column:
    """The first rule that an analysis request breaks: (request_id, kind, n_candidates, n_kernels, candidate, kernel_problem, metric_problem, has_geometry, axis_mode)."""
    r = lambda n: F.col(f"{request}.{n}")
    return (
        F.when(F.trim(F.coalesce(r("request_id"), F.lit(""))) == "", "request_id_missing")
        .when(~F.coalesce(r("axis_mode").isin("h_only", "w_only", "h_plus_w"), F.lit(False)), "axis_mode_unknown")
        .when(r("metric_problem").isNotNull(), r("metric_problem"))
        .when((r("kind") == "height") & ~F.coalesce(r("n_candidates").between(1, 100_000), F.lit(False)), "candidate_count_out_of_range")
        .when((r("kind") == "height") & r("has_geometry"), "geometry_not_allowed")
        .when((r("kind") == "kernel") & ~F.coalesce(r("n_kernels").between(2, 4096), F.lit(False)), "kernel_count_out_of_range")
        .when((r("kind") == "kernel") & r("candidate").isNull() & ~F.coalesce(r("has_geometry"), F.lit(False)), "candidate_missing")
        .when((r("kind") == "verify") & ~F.coalesce(r("has_geometry"), F.lit(False)), "geometry_missing")
        .when(r("kernel_problem").isNotNull(), r("kernel_problem"))
        .when(~F.coalesce(r("kind").isin("height", "kernel", "verify"), F.lit(False)), "kind_unknown")
    )


def with_queue_time(events: DataFrame) -> DataFrame:
    """Events whose ``telemetry`` struct also has the time between queueing and start."""
    return events.withColumn("telemetry", F.col("telemetry").withField("queue_ms", F.greatest(F.lit(0), F.col("started_ms") - F.col("queued_ms"))))


def lost_jobs(jobs: DataFrame, terminal: DataFrame) -> DataFrame:
    """When the worker is gone: unfinished jobs without a terminal event, as errors."""
    return jobs.where(F.col("phase").isin(*UNFINISHED)).join(terminal.select("job_id"), "job_id", "left_anti").select("job_id", F.lit("failed").alias("phase"), F.lit("worker_exit").alias("code"))


def completed_prefix(results: DataFrame, done: Column, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """What a cancelled job keeps: the rows before the first that isn't done."""
    first_open = F.min(F.when(~F.coalesce(done, F.lit(False)), F.col(order))).over(Window.partitionBy(*by))
    return results.withColumn("_open", first_open).where(F.col("_open").isNull() | (F.col(order) < F.col("_open"))).drop("_open")


def source_record(probes: DataFrame, indexes: DataFrame) -> DataFrame:
    """Probed sources with what the index knows better."""
    rows = probes.alias("p").join(indexes.alias("i"), "path", "left")
    pick = lambda n: F.coalesce(F.col(f"i.{n}"), F.col(f"p.{n}")).alias(n)
    return rows.select("path", pick("width"), pick("height"), pick("n_frames"), pick("fingerprint"), F.when(F.col("i.n_frames").isNotNull(), "ready").otherwise("probed").alias("state"))


def choose_backend(available: DataFrame) -> DataFrame:
    """(request_id, backend): of each request's usable backends the one with the smallest priority."""
    return available.where("usable").groupBy("request_id").agg(F.min(F.struct("priority", "backend")).alias("b")).select("request_id", "b.backend")


def recent(opened: DataFrame, most: int = 20) -> DataFrame:
    """Of each path its last opening, the latest ``most``: a list's length."""
    return opened.groupBy("path").agg(F.max("opened_at").alias("opened_at")).orderBy(F.desc("opened_at"), "path").limit(most)


def cache_to_prune(files: DataFrame, most_files: int = 64, most_bytes: int = 512 << 20) -> DataFrame:
    """The files of a cache, one row each, that don't fit beside newer ones."""
    order = Window.orderBy(F.desc("modified"), "path")
    rows = files.withColumns({"_n": F.row_number().over(order), "_b": F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("_n") > most_files) | (F.col("_b") > most_bytes)).drop("_n", "_b")


def run_scope(result: Column, snapshot: Column) -> Column:
    """(selection, every_n, start_frame, end_frame) from a result's JSON, or else its request's; all frames if neither tells."""
    get = lambda n, kind: F.coalesce(F.get_json_object(result, f"$.scan_scope.{n}"), F.get_json_object(snapshot, f"$.scan_scope.{n}")).try_cast(kind)
    return F.struct(F.coalesce(get("selection", "string"), F.lit("all")).alias("selection"), F.coalesce(get("every_n", "long"), F.lit(1)).alias("every_n"), get("start_frame", "long").alias("start_frame"), get("end_frame", "long").alias("end_frame"))


def stored_coverage(result: Column, completed: Column, total: Column) -> Column:
    """(eligible, selected, processed, failed) from a result's JSON; without one, what the run has counted."""
    get = lambda n: F.get_json_object(result, f"$.coverage.{n}").try_cast("long")
    return F.struct(F.coalesce(get("eligible"), total).alias("eligible"), F.coalesce(get("selected"), total).alias("selected"), F.coalesce(get("processed"), completed).alias("processed"), F.coalesce(get("failed"), F.lit(0)).alias("failed"))


def scope_problem(selection: Column, every_n: Column, start: Column, end: Column, stream: Column) -> Column:
    """Why a drafted scope can't be used, or null."""
    return (
        F.when(~F.coalesce(selection.isin("all", "every_n", "decoded_i_picture"), F.lit(False)), "selection_unknown")
        .when((selection == "every_n") & F.coalesce(every_n < 1, F.lit(True)), "every_n_out_of_range")
        .when(F.coalesce(stream < 0, F.lit(True)), "stream_missing")
        .when((start < 0) | (end < 0), "range_negative")
        .when(end < start, "range_reversed")
    )


def applied_payload(recipes: DataFrame, active: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """The recipes with the payload put on the active one, or else the one changed last; if there is none, a new one."""
    current = current_recipe(recipes, active).withColumns(payload)
    fresh = recipes.sparkSession.range(1).select(*(payload[c].alias(c) if c in payload else (F.lit("recipe-1") if c == "recipe_id" else F.lit(None)).cast(recipes.schema[c].dataType).alias(c) for c in recipes.columns))
    new = fresh.join(recipes.select(F.lit(1).alias("_has")).limit(1), F.lit(True), "left_anti")
    return upsert(recipes, current.unionByName(new), "recipe_id")
