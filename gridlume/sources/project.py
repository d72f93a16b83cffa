"""Project documents and exports: versioned JSON manifests, CSV and JSON of runs and fusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels

#: The documents' schema version and field names, and the export's header.
SCHEMA_VERSION = 2
MANIFEST_DDL = (
    "schema_version INT, id STRING, name STRING,"
    " sources ARRAY<STRUCT<id: STRING, path: STRING, kind: STRING, state: STRING, fingerprint: STRING>>,"
    " samples ARRAY<STRUCT<id: STRING, source_id: STRING, frame_index: BIGINT, included: BOOLEAN, sample_order: BIGINT>>,"
    " recipes ARRAY<STRUCT<id: STRING, name: STRING, created_at: STRING, updated_at: STRING, revision: BIGINT>>,"
    " run_groups ARRAY<STRUCT<id: STRING, created_at: STRING>>,"
    " runs ARRAY<STRUCT<id: STRING, run_group_id: STRING, source_id: STRING, sample_id: STRING, recipe_id: STRING, run_type: STRING, status: STRING, result: STRING>>,"
    " verification_reviews ARRAY<STRUCT<run_id: STRING, note: STRING>>"
)
COLLECTIONS = ("sources", "samples", "recipes", "run_groups", "runs", "verification_reviews")
FUSION_COLUMNS = ("fusion_id", "source_id", "frame_index", "fused_error", "winner_run_id", "winner_recipe_id", "winner_recipe_name", "candidate_count", "candidate_run_id", "candidate_recipe_id", "candidate_recipe_name", "candidate_error", "is_winner")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with ``read_only`` (a newer schema) and ``migrated`` (an older one, taken as today's); missing collections are empty."""
    rows = spark.read.schema(MANIFEST_DDL).option("multiLine", "true").json(path)
    filled = {c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)) for c in COLLECTIONS}
    version = F.coalesce("schema_version", F.lit(1))
    return rows.withColumns(filled | {"read_only": version > SCHEMA_VERSION, "migrated": version < SCHEMA_VERSION, "schema_version": F.greatest(version, F.lit(SCHEMA_VERSION))})


def collection(manifests: DataFrame, name: str) -> DataFrame:
    """One row per item, with its project."""
    return manifests.select(F.col("id").alias("project_id"), F.explode(name).alias("item")).select("project_id", "item.*")


def manifest_json(manifests: DataFrame) -> DataFrame:
    """(id, json); a manifest of a newer schema is not for writing."""
    columns = [c.split(" ")[0] for c in ("schema_version", "id", "name", *COLLECTIONS)]
    return manifests.where("NOT read_only").select("id", F.to_json(F.struct(*columns)).alias("json"))


def write_manifest(manifests: DataFrame, path: str) -> None:
    """Through a committer, so that readers see the old files or the new ones; refuses a newer schema."""
    if manifests.where("read_only").limit(1).count():
        raise ValueError("a project of a newer schema is read only")
    manifest_json(manifests).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def run_csv(rows: DataFrame) -> DataFrame:
    """(value) lines ``run_id,run_type,series_key,metric``; only a key with a comma is quoted."""
    return rows.select(F.concat_ws(",", "run_id", "run_type", labels.comma_cell(F.col("series_key")), labels.number_text(F.col("metric"))).alias("value"))


def run_json(rows: DataFrame) -> DataFrame:
    """(run_id, value): one document per run."""
    points = F.array_sort(F.collect_list(F.struct("x", "series_key", "metric")))
    return rows.groupBy("run_id", "run_type").agg(points.alias("rows")).select("run_id", F.to_json(F.struct("run_id", "run_type", "rows")).alias("value"))


def fusion_rows(fusion: DataFrame, names: DataFrame, fusion_id: str, source_id: str) -> DataFrame:
    """One row per frame and candidate in FUSION_COLUMNS; ``names`` is (recipe_id, name), empty where unknown."""
    rows = fusion.select("frame_index", "fused_error", "winner_run_id", "winner_recipe_id", "candidate_count", F.explode("candidates").alias("c"))
    name = lambda side: names.select(F.col("recipe_id").alias(f"{side}_recipe_id"), F.col("name").alias(f"{side}_recipe_name"))
    rows = rows.select("*", F.col("c.run_id").alias("candidate_run_id"), F.col("c.recipe_id").alias("candidate_recipe_id"), F.col("c.error").alias("candidate_error"))
    rows = rows.join(name("winner"), "winner_recipe_id", "left").join(name("candidate"), "candidate_recipe_id", "left").fillna("", ["winner_recipe_name", "candidate_recipe_name"])
    winner = (F.col("candidate_run_id") == F.col("winner_run_id")) & (F.col("candidate_recipe_id") == F.col("winner_recipe_id")) & (F.col("candidate_error") == F.col("fused_error"))
    return rows.withColumns({"fusion_id": F.lit(fusion_id), "source_id": F.lit(source_id), "is_winner": winner}).select(*FUSION_COLUMNS)


def fusion_csv(rows: DataFrame) -> DataFrame:
    """(frame_index, value) lines; cells with quotes, commas or line ends are quoted."""
    numbers = ("fused_error", "candidate_error")
    cells = [labels.number_text(F.col(c)) if c in numbers else labels.csv_cell(F.col(c)) for c in FUSION_COLUMNS]
    return rows.select("frame_index", F.concat_ws(",", *cells).alias("value"))


def fusion_json(fusion: DataFrame) -> DataFrame:
    return fusion.select("frame_index", F.to_json(F.struct("frame_index", "fused_error", "winner_run_id", "winner_recipe_id", "candidate_count", "candidates")).alias("value"))
