"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, editcount, langid, media, mixing, secrets, toxicity, urls
from .setjoin import jaccard_components

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tree before and after edits: a replacement, a short and a long insertion, a removal and insertions at one place."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    length = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda place, removed, inserted: F.struct(place.cast("long").alias("place"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    at_one_place = [edit(F.floor(length / 3), 0, f" remark number {k} of a reviewer who returns") for k in range(10)]
    edits = F.array(edit(F.floor(length / 4), 5, "it's 42"), edit(F.floor(length / 2), 0, "\n[edited] "), edit(F.floor(3 * length / 4), 9, ""), edit(F.floor(length / 5), 0, " a passage that was moved here" * 70), *at_one_place)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    trees = editcount.count_tokens(docs, ranks, public_tokenizers.PATTERN, extra=("edits",))
    edited = editcount.apply_edits(trees, ranks, public_tokenizers.PATTERN)
    return edited.select(F.col("id").alias("doc_id"), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), "encoded_chars")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    return found.select("doc_id", *(c.alias(n) for n, c in secrets.digest().items()))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text", toxicity.held_out("doc_id").alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 64 consecutive vectors each (the last may be lower), and of each a crop by 8 pixels a side with changed brightness and contrast.

    The crop of image i has the id -1 - i. (image_id, width, pixels)
    """
    lines = _table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("image_id"), "vec_id", "embedding")
    stacked = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("lines"))
    rows = stacked.select("image_id", F.transform("lines", lambda x: x["embedding"]).alias("rows"))
    whole = rows.select("image_id", F.lit(64).alias("width"), F.flatten("rows").alias("pixels"))
    cropped = F.flatten(F.transform(F.slice("rows", 9, F.greatest(F.lit(0), F.size("rows") - 16)), lambda r: F.transform(F.slice(r, 9, 48), lambda x: (x * 0.7 + 0.1).cast("float"))))
    return whole.unionByName(rows.select((-1 - F.col("image_id")).alias("image_id"), F.lit(48).alias("width"), cropped.alias("pixels")))


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(image_variants(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_edit_aware_token_counts": op2_edit_aware_token_counts,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_filters": op4_url_filters,
    "op5_byte_level_bpe": op5_byte_level_bpe,
    "op6_secret_scans": op6_secret_scans,
    "op7_source_mixing": op7_source_mixing,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_media_copies": op10_media_copies,
}

_LOWER = f"'{urls.UPPER}', '{urls.LOWER}'"
_PARTS = f"""SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {_LOWER}), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
 coalesce(translate(url, {_LOWER}), '') AS low, contains(coalesce(url, ''), '://') AS whole FROM pages"""
_ANY_HOST = "://([^/?#]*[.@])?"
_END = "([^a-z0-9_.%-]|$)"

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, comp) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.doc_id)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(comp) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id""",
    "op4_url_filters": f"""SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN whole AND NOT regexp_matches(low, '/wiki/') AND (
 regexp_matches(low, '{_ANY_HOST}casino-') OR regexp_matches(low, '{_ANY_HOST}free-bets[.]') OR regexp_matches(low, '{_ANY_HOST}cheap-pills[.]') OR regexp_matches(low, '/(login|signup|cart){_END}')
 OR regexp_matches(low, '/ads/') OR regexp_matches(low, '[^a-z0-9_.%-]utm_source=spam{_END}')) THEN 'block' ELSE 'allow' END AS verdict FROM (
 SELECT *, CASE WHEN host = 'www.example.com' AND starts_with(path, '/en/') OR ends_with(host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM ({_PARTS}))""",
}
