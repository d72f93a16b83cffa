"""Names, labels and keys of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import decimal_text

#: Spellings of run types and statuses and what they mean.
RUN_TYPES = {"height_scan": "height", "height": "height", "kernel_scan": "kernel", "kernel": "kernel", "verification": "verification", "verify": "verification"}
RUN_STATUSES = {"queued": "queued", "pending": "queued", "running": "running", "completed": "completed", "done": "completed", "partial": "partial", "cancelled": "cancelled", "canceled": "cancelled", "failed": "failed", "error": "failed"}


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_replace(path, r"^.*[/\\]", "")


def from_vocabulary(value: Column, words: dict[str, str], default: str) -> Column:
    out = F.when(F.lit(False), "")
    for word, meaning in words.items():
        out = out.when(F.lower(value) == word, meaning)
    return out.otherwise(default)


def short_fingerprint(fingerprint: Column) -> Column:
    """The first six hex digits after the algorithm's name."""
    return F.substring(F.substring_index(fingerprint, ":", -1), 1, 6)


def source_label(path: Column, fingerprint: Column) -> Column:
    return F.when(F.trim(F.coalesce(fingerprint, F.lit(""))) == "", file_name(path)).otherwise(F.concat(file_name(path), F.lit(" (#"), short_fingerprint(fingerprint), F.lit(")")))


def stream_key(id: Column, fingerprint: Column, stream: Column) -> Column:
    return F.concat_ws(":", id, F.coalesce(fingerprint, F.lit("")), F.coalesce(stream.cast("string"), F.lit("")))


def seconds_text(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "-").otherwise(F.format_string("%.3f s", seconds))


def dimension_text(width: Column, height: Column) -> Column:
    return F.when(width.isNull() | height.isNull(), "-").otherwise(F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def toggled(values: Column, value: Column) -> Column:
    """The set without the value if it has it, else with it."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.concat(values, F.array(value)))


def recipe_name(width: Column, height: Column, kernel_label: Column, unknown_size: str = "?", unknown_kernel: str = "?") -> Column:
    """``WxH-kernel(k=v,...)``; null if neither is known."""
    size = F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise(unknown_size)
    return F.when(width.isNull() & kernel_label.isNull(), F.lit(None)).otherwise(F.concat(size, F.lit("-"), F.coalesce(kernel_label, F.lit(unknown_kernel))))


def unique_names(rows: DataFrame, name: str, id: str) -> DataFrame:
    """Names with ``-2``, ``-3`` after the first by id; a suffixed name may in turn be taken by a plain one, which comes first."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(name).orderBy(id))
    return rows.withColumn("_n", place).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def geometry_key(source_width: Column, source_height: Column, base_height: Column, base_width: Column, profile_id: Column) -> Column:
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(source_width.cast("string"), F.lit("x"), source_height.cast("string"), F.lit("@"), none(base_height), F.lit("@"), none(base_width), F.lit("@"), none(profile_id))


def csv_cell(value: Column) -> Column:
    """Quoted where it holds a quote, comma or line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def comma_cell(value: Column) -> Column:
    """Quoted only where it holds a comma."""
    return F.when(value.contains(","), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def number_text(value: Column) -> Column:
    return decimal_text(value.cast("decimal(30,12)"))


def snake_case_keys(json: Column) -> Column:
    """JSON text whose object keys go from camelCase to snake_case; string values stay as they are."""
    # a key is a quoted name before a colon; humps are split from the last to the first
    key = r'"((?:[^"\\]|\\.)*)"(?=\s*:)'
    parts = F.split(F.regexp_replace(json, key, "\u0001$1\u0002"), "\u0001")
    lowered = lambda p: F.when(p.contains("\u0002"), F.concat(F.lit('"'), F.lower(F.regexp_replace(F.substring_index(p, "\u0002", 1), "([A-Z])", "_$1")), F.lit('"'), F.substring(p, F.length(F.substring_index(p, "\u0002", 1)) + 2, F.length(p)))).otherwise(p)
    return F.array_join(F.transform(parts, lowered), "")
