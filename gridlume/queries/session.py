"""Sessions, changed files, ordered sums and animations over the fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..operators import metrics, session
from ..sources import files
from .common import rounded, table


def frame_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events use twelve frames."""
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(F.lit("/f"), F.floor("value") % 12).alias("frame_key"))
    return session.cache_hits(uses).select("session_id", "seq", "hit")


def shared_index_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("path"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("fingerprint"))
    return session.shared_jobs(requests, ("path", "fingerprint"))


def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("user_id")).alias("request_id"))
    return session.routed(events, table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("request_id")))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are files, of which every fifth has grown and every seventh had no fingerprint."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    sources = docs.select("path", F.when(F.col("doc_id") % 7 > 0, files.fingerprint(F.col("text").cast("binary"))).alias("fingerprint"))
    now = docs.select("path", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return files.changed(sources, now).select("path")


def lanczos_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_linenumber") % 3 - 1 + F.col("l_suppkey") % 3).cast("int")).alias("taps"))
    return rows.select("l_orderkey", F.concat_ws(",", grids.lanczos_list(F.col("taps"))).alias("taps"))


def pnorm_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of quantities from 25 by supplier, in the order of the lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), ((F.col("l_quantity") - 25) / 10).alias("d"))
    return metrics.p_norm_in_order(rows, "l_suppkey", "place", "d", 0.5, 2).select("l_suppkey", rounded("error", 8))


def animated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up chunks, by document number: animations, still ones, marks inside other chunks and across half bytes."""
    png, chunk = "89504E470D0A1A0A", lambda kind, body="": f"{len(body) // 2:08X}{kind.encode().hex().upper()}{body}00000000"
    heads = (
        ("png", png + chunk("IHDR", "00" * 13) + chunk("acTL", "00" * 8) + chunk("IDAT")),
        ("png", png + chunk("IHDR", "00" * 13) + chunk("IDAT", "6163544C") + chunk("acTL", "00" * 8)),
        ("png", png + chunk("tEXt", "006163544C") + chunk("IDAT")),
        ("png", png + chunk("tEXt", "06163544C0") + chunk("IDAT")),
        ("webp", "524946462000000057454250" + "56503858" + "0A000000" + "02" + "00" * 9),
        ("webp", "524946462000000057454250" + "56503820" + "04000000" + "414E494D"),
        ("bmp", "424D" + "6163544C"),
    )
    pick = lambda c: F.get(F.array(*(F.lit(h[c]) for h in heads)), (F.col("doc_id") % len(heads)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.unhex(pick(1)).alias("content"), pick(0).alias("format"))
    return rows.select("doc_id", files.is_animated(F.col("content"), F.col("format")).alias("animated"))


QUERIES = {f.__name__: f for f in (frame_cache, shared_index_jobs, routed_events, changed_files, lanczos_lists, pnorm_in_order, animated_images)}

ORACLES = {
    "frame_cache": """WITH u AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 12 AS k FROM events), p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id, k ORDER BY event_id) AS before FROM u)
 SELECT user_id AS session_id, event_id AS seq, before IS NOT NULL AND (SELECT count(DISTINCT o.k) FROM u o WHERE o.user_id = p.user_id AND o.event_id > p.before AND o.event_id < p.event_id) < 8 AS hit FROM p""",
    "shared_index_jobs": """SELECT o_orderkey AS request_id, first_value(o_orderkey) OVER w AS job_id, o_orderkey = first_value(o_orderkey) OVER w AS starts FROM orders WINDOW w AS (PARTITION BY o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END ORDER BY o_orderdate, o_orderkey)""",
    "routed_events": """WITH e AS (SELECT event_id AS seq, CASE WHEN event_type <> 'view' THEN user_id END AS request_id FROM events)
 SELECT seq, request_id, CASE WHEN request_id % 2 = 0 AND request_id // 2 IN (SELECT c_custkey FROM customer) AND row_number() OVER (PARTITION BY request_id ORDER BY seq) = 1 THEN 'answer' ELSE 'event' END AS target FROM e""",
    "changed_files": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 > 0",
    "lanczos_lists": """SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN t >= 1 THEN CAST(t AS VARCHAR) END, ',' ORDER BY CASE WHEN t >= 1 THEN CAST(t AS VARCHAR) END), '') AS taps FROM (SELECT l_orderkey, l_linenumber % 3 - 1 + l_suppkey % 3 AS t FROM lineitem) GROUP BY 1""",
    "pnorm_in_order": "SELECT l_suppkey, round(sqrt(sum(CASE WHEN abs((l_quantity - 25) / 10) > 0.5 THEN ((l_quantity - 25) / 10) ^ 2 ELSE 0 END) / count(*)), 8) AS error FROM lineitem GROUP BY 1",
    "animated_images": "SELECT doc_id, doc_id % 7 IN (0, 4) AS animated FROM documents",
}
