"""Frame indexes: the text format with one line per frame, and the table with its guard columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_VERSION = 1
#: A frame's keys in the text format, and its columns.
KEYS = (("Index", "stream"), ("POS", "file_position"), ("PTS", "pts"), ("DTS", "dts"), ("EDI", "extradata"))
FRAME_KEYS = (("Key", "key"), ("Pic", "picture"), ("POC", "poc"), ("Repeat", "repeat"), ("Field", "field"))


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, stream, file_position, pts, dts, extradata, key, picture, poc, repeat, field) of text indexes.

    A frame is two lines: ``Index=..,POS=..,PTS=..,DTS=..,EDI=..`` and ``Key=..,Pic=..,POC=..,Repeat=..,Field=..``.
    Whole files are read as rows, so a frame's lines stay together; other lines are left out, and the
    smallest 64-bit number stands for an unknown time.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    pairs = text.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(Index=[^\n]*\n[^\n]*Key=[^\n]*)"), 1)).alias("line", "pair"))
    field = lambda k: F.nullif(F.regexp_extract("pair", rf"(?:^|[,\n ]){k}=(-?[0-9]+)", 1), F.lit("")).cast("long")
    unknown = F.lit(-(1 << 63))
    columns = [F.nullif(field(k), unknown).alias(c) for k, c in KEYS + FRAME_KEYS]
    return pairs.select("path", "line", *columns)


def text_lines(frames: DataFrame) -> DataFrame:
    """(decode_index, value): the two lines of each frame; unknown times are the smallest number."""
    number = lambda c, default="0": F.coalesce(F.col(c).cast("string"), F.lit(default))
    unknown = str(-(1 << 63))
    first = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), number(c, unknown if c in ("pts", "dts") else "0")) for k, c in KEYS))
    second = F.concat_ws(",", *(F.concat(F.lit(f"{k}="), number(c)) for k, c in FRAME_KEYS))
    return frames.select("decode_index", F.concat_ws("\n", first, second).alias("value"))


def write_text_index(frames: DataFrame, path: str) -> None:
    """One file per partition of the ordered frames; one index is one stream, so frames are few enough for one."""
    text_lines(frames).orderBy("decode_index").select("value").coalesce(1).write.mode("overwrite").text(path)


def with_guards(frames: DataFrame, path: str, size: int, modified: int, fingerprint: str) -> DataFrame:
    """The index as a table: columns that tell whether it fits its file, and a checksum of every row."""
    guards = {"index_version": F.lit(INDEX_VERSION), "media_path": F.lit(path), "media_size": F.lit(size), "media_modified": F.lit(modified), "fingerprint": F.lit(fingerprint)}
    return frames.withColumns(guards).withColumn("checksum", F.xxhash64(*sorted(frames.columns)))


def valid_rows(index: DataFrame, columns: list[str], path: str, size: int, modified: int, fingerprint: str | None = None) -> DataFrame:
    """The rows of an index that fits; a row of another version, file or checksum doesn't."""
    fits = (F.col("index_version") == INDEX_VERSION) & (F.col("media_path") == path) & (F.col("media_size") == size) & (F.col("media_modified") == modified)
    if fingerprint is not None:
        fits = fits & (F.col("fingerprint") == fingerprint)
    return index.where(fits & (F.col("checksum") == F.xxhash64(*sorted(columns)))).select(*columns)


def ensure_index(spark: SparkSession, location: str, build, **guards) -> tuple[DataFrame, bool]:
    """(frames, whether it was built): from the first table that fits and is whole, else ``build()``, which is then written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.parquet(location)
        columns = [c for c in held.columns if c not in ("index_version", "media_path", "media_size", "media_modified", "fingerprint", "checksum")]
        rows = valid_rows(held, columns, **guards)
        kept, all_rows = rows.count(), held.count()
        if kept and kept == all_rows:
            return rows, False
    frames = build()
    with_guards(frames, **guards).write.mode("overwrite").parquet(location)
    return spark.read.parquet(location).select(*frames.columns), True
