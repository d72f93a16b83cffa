"""Requests before and after their jobs: shape guards, queueing and cancelling, rows of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFICATIONS = ("verification", "verify")


def _first(rules: list[tuple[Column, str]]) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for broken, reason in rules[1:]:
        out = out.when(broken, reason)
    return out


def shape_problem(request: str, mode: str) -> Column:
    """The first reason why a request isn't a whole one of that mode, or null.

    A struct (mode, sample_id, source_id, source_path, recipe_id, profile_id, kernel_id, geometry,
    n_candidates, kernels, concurrency, stream_index, selection, every_n, start_frame, end_frame,
    crops, threshold, norm): ``kernels`` lists each kernel with its parameters as one text, ``crops``
    the four margins.
    """
    r = lambda n: F.col(f"{request}.{n}")
    missing = lambda n: F.coalesce(r(n).cast("string"), F.lit("")) == ""
    less = lambda v, least: F.coalesce(v < least, F.lit(True))
    whole = lambda v: F.coalesce(v == F.floor(v), F.lit(False))
    metric = [
        (F.coalesce(F.exists(r("crops"), lambda c: less(c, 0) | ~whole(c)), F.lit(True)), "metric_crop_invalid"),
        (less(r("threshold"), 0) | F.isnan(r("threshold")) | (r("threshold") == float("inf")), "metric_exclusion_invalid"),
        (less(r("norm"), 1) | ~whole(r("norm")), "metric_p_norm_invalid"),
    ]
    profile = [(missing("profile_id"), f"{mode}_profile_required")]
    start = [(~F.coalesce(r("mode") == mode, F.lit(False)), f"{mode}_mode_mismatch")]
    if mode == "height":
        own = [(missing("sample_id"), "height_sample_required"), (missing("kernel_id"), "height_kernel_required"), (less(r("n_candidates"), 1), "height_grid_empty"), (r("n_candidates") < 2, "height_grid_too_small")]
        return _first(start + own + metric + profile)
    if mode == "kernel":
        n = F.coalesce(F.size(r("kernels")), F.lit(0))
        own = [(missing("sample_id"), "kernel_sample_required"), (missing("geometry"), "kernel_geometry_required"), (n < 1, "kernel_list_empty"), (n < 2, "kernel_list_too_small"), (F.size(F.array_distinct(r("kernels"))) < n, "kernel_list_duplicate")]
        return _first(start + own + metric + profile)
    own = [
        (missing("source_id") | missing("source_path"), "verify_source_required"),
        (missing("recipe_id"), "verify_recipe_required"),
        (missing("kernel_id"), "verify_kernel_required"),
        (missing("geometry"), "verify_geometry_required"),
        (~F.coalesce(r("concurrency").between(1, 8), F.lit(False)) | ~whole(r("concurrency")), "verify_concurrency_invalid"),
        (less(r("stream_index"), 0), "verify_stream_required"),
        (F.coalesce(r("selection") == "every_n", F.lit(False)) & less(r("every_n"), 1), "verify_every_n_invalid"),
        (F.coalesce(r("start_frame") > r("end_frame"), F.lit(False)), "verify_range_invalid"),
    ]
    return _first(start + own + metric)


def job_requests(events: DataFrame, terminal: tuple[str, ...] = ("completed", "cancelled", "failed", "partial")) -> DataFrame:
    """(job_id, total, ended, cancel_requested) of jobs from rows (job_id, seq, event, total), an event being ``queue``, ``cancel`` or a phase.

    A job that is queued again starts anew. Cancelling counts from the queueing to the job's end;
    before and after it is ignored, and so are events of a job that was never queued.
    """
    queued = events.where("event = 'queue'").groupBy("job_id").agg(F.max(F.struct("seq", F.greatest(F.lit(0), F.coalesce("total", F.lit(0))).alias("total"))).alias("q"))
    since = events.join(queued, "job_id").where(F.col("seq") > F.col("q.seq"))
    ends = since.groupBy("job_id").agg(F.min(F.when(F.col("event").isin(*terminal), F.col("seq"))).alias("end"), F.min(F.when(F.col("event") == "cancel", F.col("seq"))).alias("asked"))
    asked = F.coalesce(F.col("asked").isNotNull() & (F.col("end").isNull() | (F.col("asked") < F.col("end"))), F.lit(False))
    return queued.join(ends, "job_id", "left").select("job_id", "q.total", F.col("end").isNotNull().alias("ended"), asked.alias("cancel_requested"))


def kernel_result_rows(runs: DataFrame, samples: DataFrame, metric_key: str) -> DataFrame:
    """(run_id, sample_id, kernel_id, kernel_label, metric, sample_label) of runs whose metric can be compared with the chosen one; a run that doesn't tell is taken.

    runs: run_id, sample_id, metric_key, results, an array of (kernel_id, parameters, metric) whose
    parameters are an array of (name, value). samples: sample_id, label.
    """
    fits = F.coalesce(F.col("metric_key") == metric_key, F.lit(True))
    rows = runs.where(fits).select("run_id", "sample_id", F.explode("results").alias("k")).join(samples.select("sample_id", "label"), "sample_id", "left")
    named = F.array_join(F.transform(F.coalesce("k.parameters", F.array().cast("array<struct<name: string, value: string>>")), lambda p: F.concat(p["name"], F.lit("="), p["value"])), ", ")
    label = F.when(named == "", F.col("k.kernel_id")).otherwise(F.concat("k.kernel_id", F.lit(" ("), named, F.lit(")")))
    return rows.select("run_id", F.coalesce("sample_id", F.lit("")).alias("sample_id"), "k.kernel_id", label.alias("kernel_label"), "k.metric", F.coalesce("label", "sample_id", F.lit("—")).alias("sample_label"))


def incompatible_runs(runs: DataFrame, metric_key: str) -> DataFrame:
    """(incompatible): how many runs ``kernel_result_rows`` leaves out."""
    return runs.agg(F.count_if(F.coalesce(F.col("metric_key") != metric_key, F.lit(False))).alias("incompatible"))


def by_metric(direction: str, metric: str = "metric", place: str = "place") -> list[Column]:
    """The order of a result table: as it is, or by the metric, equal ones as they are."""
    if direction not in ("none", "asc", "desc"):
        raise ValueError("direction is none, asc or desc")
    return [F.col(place)] if direction == "none" else [F.asc(metric) if direction == "asc" else F.desc(metric), F.col(place)]


def verification_runs(runs: DataFrame) -> DataFrame:
    """All columns of the runs that verify, and their ``place`` within their source, the latest first."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source_id").orderBy(F.desc("created_at"), "run_id")
    return runs.where(F.col("run_type").isin(*VERIFICATIONS)).withColumn("place", F.row_number().over(order))
