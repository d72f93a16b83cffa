"""Names, labels, exports, fingerprints and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, labels
from ..sources import files, project
from .common import table


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", files.fingerprint(F.col("text").cast("binary")).alias("fingerprint"))


def image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up headers, by document number."""
    heads = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "424D", "49492A00", "52494646000000005745425056503820", "00")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.get(F.array(*(F.lit(h) for h in heads)), (F.col("doc_id") % 7).cast("int"))).alias("content"), F.concat(F.lit("/a/b."), F.when(F.col("doc_id") % 3 == 0, "PNG").when(F.col("doc_id") % 3 == 1, "webp").otherwise("txt")).alias("path"))
    return rows.select("doc_id", F.coalesce(files.image_format(F.col("content"), F.col("path")), F.lit("none")).alias("format"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", labels.file_name(F.col("url")).alias("name"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("quick-sha256-v1:"), F.sha2("url", 256))).alias("fp"))
    return rows.select("page_id", labels.source_label(F.col("url"), F.col("fp")).alias("label"), labels.stream_key(F.col("page_id").cast("string"), F.col("fp"), F.lit(0)).alias("stream_key"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "canceled").otherwise("odd")
    return table(spark, sf_dir, "orders").select(labels.from_vocabulary(words, labels.RUN_STATUSES, "unknown").alias("status"), labels.from_vocabulary(F.lit("height_scan"), labels.RUN_TYPES, "unknown").alias("run_type")).groupBy("status", "run_type").agg(F.count(F.lit(1)).alias("n"))


def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", labels.seconds_text(F.when(F.col("p_size") > 5, F.col("p_size") / 8)).alias("seconds"), labels.dimension_text(F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey"))).alias("size"))


def recipe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("k", F.struct(F.when(F.col("p_size") % 3 == 0, "bicubic").when(F.col("p_size") % 3 == 1, "lanczos").otherwise("spline36").alias("id"), F.lit(0.0).alias("b"), F.lit(0.5).alias("c"), F.lit(4).alias("taps")))
    named = rows.select("p_partkey", labels.recipe_name(F.col("p_size") + 1000, F.col("p_size") + 500, kernels.label(F.col("k"))).alias("name"))
    return labels.unique_names(named, "name", "p_partkey").select("p_partkey", "unique_name")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit("height").alias("run_type"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_orderpriority"), F.lit(',"x"'))).otherwise(F.col("o_orderpriority")).alias("series_key"), F.col("o_totalprice").alias("metric"))
    return project.run_csv(rows)


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(labels.csv_cell(F.col("text")), 256).alias("cell"))


def snake_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"frameIndex":'), F.col("event_id").cast("string"), F.lit(',"someLongKey":"keepThis: \\"aB\\"","x":{"innerKey":[1,2]}}'))
    return table(spark, sf_dir, "events").select("event_id", labels.snake_case_keys(text).alias("json"))


def toggled_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.array(F.lit("A"), F.lit("N"))
    return table(spark, sf_dir, "lineitem").groupBy(F.array_join(labels.toggled(base, F.col("l_returnflag")), "").alias("members")).agg(F.count(F.lit(1)).alias("n"))


def geometry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").groupBy(labels.geometry_key(F.lit(1920), F.lit(1080), n, F.lit(None), F.lit("exact")).alias("geometry_key")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (fingerprints, image_formats, file_names, source_labels, vocabulary, display_text, recipe_names, csv_rows, csv_cells, snake_keys, toggled_sets, geometry_keys)}

_LE = " || ".join(f"substr(h, {2 * k + 1}, 2)" for k in range(7, -1, -1))
ORACLES = {
    # texts are up to 64 KiB or longer: the tail counts only for longer ones
    "fingerprints": f"""SELECT doc_id, 'quick-sha256-v1:' || sha256(unhex({_LE}) || b[1:65536] || CASE WHEN octet_length(b) > 65536 THEN b[octet_length(b) - 65535:octet_length(b)] ELSE ''::BLOB END) AS fingerprint
 FROM (SELECT doc_id, encode(text) AS b, lpad(to_hex(octet_length(encode(text))), 16, '0') AS h FROM documents)""",
    "image_formats": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'none' ELSE ['png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp', 'none'][doc_id % 7 + 1] END AS format FROM documents""",
    "file_names": "SELECT page_id, regexp_replace(url, '^.*[/\\\\]', '') AS name FROM pages",
    "source_labels": """SELECT page_id, regexp_replace(url, '^.*[/\\\\]', '') || CASE WHEN page_id % 4 <> 0 THEN ' (#' || substr(sha256(url), 1, 6) || ')' ELSE '' END AS label,
 page_id || ':' || CASE WHEN page_id % 4 <> 0 THEN 'quick-sha256-v1:' || sha256(url) ELSE '' END || ':0' AS stream_key FROM pages""",
    "vocabulary": "SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' ELSE 'unknown' END AS status, 'height' AS run_type, count(*) AS n FROM orders GROUP BY 1, 2",
    "display_text": "SELECT p_partkey, CASE WHEN p_size > 5 THEN printf('%.3f s', p_size / 8.0) ELSE '-' END AS seconds, CASE WHEN p_size % 2 = 0 THEN p_size || 'x' || p_partkey ELSE '-' END AS size FROM part",
    "recipe_names": """SELECT p_partkey, CASE WHEN r = 1 THEN name ELSE name || '-' || r END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS r FROM (
 SELECT p_partkey, (p_size + 1000) || 'x' || (p_size + 500) || '-' || ['bicubic(b=0,c=0.5)', 'lanczos(taps=4)', 'spline36'][p_size % 3 + 1] AS name FROM part))""",
    "csv_rows": """SELECT concat_ws(',', o_orderkey, 'height', CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_orderpriority || ',""x""\"' ELSE o_orderpriority END, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')) AS value FROM orders""",
    "csv_cells": """SELECT doc_id, sha256(CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS cell FROM documents""",
    "snake_keys": """SELECT event_id, '{"frame_index":' || event_id || ',"some_long_key":"keepThis: \\"aB\\"","x":{"inner_key":[1,2]}}' AS json FROM events""",
    "toggled_sets": "SELECT CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'A' ELSE 'AN' || l_returnflag END AS members, count(*) AS n FROM lineitem GROUP BY 1",
    "geometry_keys": "SELECT '1920x1080@' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END || '@@exact' AS geometry_key, count(*) AS n FROM part GROUP BY 1",
}
