"""Fusion of verification runs: of each frame the smallest error that any run has, and whose it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(frames: DataFrame, runs: DataFrame, recipes: DataFrame) -> DataFrame:
    """(frame_index, error, created_at, recipe_id, run_id) of frames (run_id, frame_index, error) with an error."""
    rows = frames.where("error IS NOT NULL").join(runs.select("run_id", "recipe_id"), "run_id")
    return rows.join(recipes.select("recipe_id", F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at")), "recipe_id").select("frame_index", "error", "created_at", "recipe_id", "run_id")


def fused(rows: DataFrame) -> DataFrame:
    """(frame_index, fused_error, winner_run_id, winner_recipe_id, candidate_count, tied, candidates).

    Ties go to the recipe created first, then to the smaller recipe and run id. One aggregation; a
    frame has one candidate per run.
    """
    item = F.struct("error", "created_at", "recipe_id", "run_id")
    grouped = rows.groupBy("frame_index").agg(F.array_sort(F.collect_list(item)).alias("all"))
    winner = F.col("all")[0]
    return grouped.select(
        "frame_index",
        winner["error"].alias("fused_error"),
        winner["run_id"].alias("winner_run_id"),
        winner["recipe_id"].alias("winner_recipe_id"),
        F.size("all").cast("long").alias("candidate_count"),
        (F.size(F.filter("all", lambda x: x["error"] == winner["error"])) > 1).alias("tied"),
        F.transform("all", lambda x: F.struct(x["run_id"].alias("run_id"), x["recipe_id"].alias("recipe_id"), x["error"].alias("error"))).alias("candidates"),
    )


def statistics(fusion: DataFrame) -> DataFrame:
    """(total_frames, single_candidate_frames, multi_candidate_frames, tied_frames)."""
    one = F.col("candidate_count") == 1
    return fusion.agg(F.count(F.lit(1)).alias("total_frames"), F.count_if(one).alias("single_candidate_frames"), F.count_if(~one).alias("multi_candidate_frames"), F.count_if("tied").alias("tied_frames"))


def wins(fusion: DataFrame, recipes: DataFrame) -> DataFrame:
    """(recipe_id, wins) of all recipes that take part, 0 for those that win nothing."""
    counts = fusion.groupBy(F.col("winner_recipe_id").alias("recipe_id")).agg(F.count(F.lit(1)).alias("wins"))
    return recipes.select("recipe_id").distinct().join(counts, "recipe_id", "left").select("recipe_id", F.coalesce("wins", F.lit(0)).alias("wins"))


def eligibility(run: str = "run", source: str = "source", recipe: str = "recipe") -> Column:
    """The first reason why a run can't be fused, or null. Struct columns:

    run (run_type, status, source_id, source_fingerprint, stream_index, recipe_revision, metric_key,
    axis_mode, profile_id, math_mode, expected, selected, failed, n_frames, bad_frames),
    source (source_id, kind, state, fingerprint), recipe (recipe_id, revision, metric_key, axis_mode,
    profile_id, math_mode, complete).
    """
    r, s, p = (lambda n: F.col(f"{run}.{n}")), (lambda n: F.col(f"{source}.{n}")), (lambda n: F.col(f"{recipe}.{n}"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    rules = (
        (~F.coalesce(r("run_type").isin("verification", "verify"), F.lit(False)), "not_verification_run"),
        (differs(r("status"), F.lit("completed")), "status_not_completed"),
        (differs(r("source_id"), s("source_id")), "source_mismatch"),
        (differs(s("kind"), F.lit("video")) | F.coalesce(s("state").isin("missing", "unsupported", "error"), F.lit(False)), "source_unavailable"),
        (F.trim(F.coalesce(s("fingerprint"), F.lit(""))) == "", "source_fingerprint_missing"),
        (differs(r("source_fingerprint"), s("fingerprint")), "source_fingerprint_mismatch"),
        (F.coalesce(r("stream_index") < 0, F.lit(True)), "stream_missing"),
        (p("recipe_id").isNull() | ~F.coalesce(p("complete"), F.lit(False)), "recipe_snapshot_missing"),
        (differs(r("recipe_revision"), p("revision")), "recipe_revision_mismatch"),
        (differs(r("metric_key"), p("metric_key")), "metric_mismatch"),
        (differs(r("axis_mode"), p("axis_mode")), "axis_mode_mismatch"),
        (differs(r("profile_id"), F.coalesce(p("profile_id"), F.lit(""))), "profile_mismatch"),
        (differs(r("math_mode"), F.coalesce(p("math_mode"), F.lit("raw"))), "math_mode_mismatch"),
        (F.coalesce(r("bad_frames") > 0, F.lit(False)), "invalid_frames"),
        (F.coalesce(r("n_frames"), F.lit(0)) == 0, "metrics_incomplete"),
        (F.coalesce((r("expected") <= 0) | (r("failed") != 0) | (r("expected") != r("selected")) | (r("n_frames") != r("expected")), F.lit(True)), "metrics_incomplete"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for rule, reason in rules[1:]:
        out = out.when(rule, reason)
    return out


def compatibility(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(reason) per group: why runs (recipe_id, stream_index, metric_key, axis_mode, profile_id, math_mode) can't be fused with each other, or null."""
    many = lambda c: F.count_distinct(F.struct(c)) > 1
    reason = (
        F.when(F.count(F.lit(1)) < 2, "need_two_runs")
        .when(F.count_distinct("recipe_id") < F.count(F.lit(1)), "duplicate_recipe")
        .when(many("stream_index"), "stream_mismatch")
        .when(many("metric_key"), "metric_mismatch")
        .when(many("axis_mode"), "axis_mode_mismatch")
        .when(many("profile_id"), "profile_mismatch")
        .when(many("math_mode"), "math_mode_mismatch")
    )
    return runs.groupBy(*by).agg(reason.alias("reason"))
