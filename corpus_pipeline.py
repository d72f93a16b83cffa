"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlume.llm import bpe, mixing, secrets, toxicity
from gridlume.llm.queries import RANKS
from gridlume.llm.scratch import Scratch
from gridlume.llm.setjoin import jaccard_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest id, null after all others, then hashes of the text and the other columns.

    Rows are named by all of these, so that rows that share an id, or have none, are told apart.
    """
    rest = F.struct(*(c for c in COLUMNS if c not in ("doc_id", "text")))
    docs = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(F.to_json(rest)).alias("rest")).alias("row_id"))
    keepers = jaccard_components(docs, "row_id").where("row_id = component_id").select(F.col("row_id").alias("keeper")).distinct()
    return docs.join(keepers, F.col("row_id") == F.col("keeper"), "left_semi").dropDuplicates(["row_id"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that hold secrets are replaced by a mark; every document stays."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids and the digest of the bytes that they decode to."""
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]

#: SQL can express neither the factorization machine nor the dual's solution.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
