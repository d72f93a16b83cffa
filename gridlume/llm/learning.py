"""What the trained operators share: the split, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text is divisible by FOLDS; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def may_learn(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS != 0, F.lit(False))


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """All rows, or the ``most`` with the smallest hashes of their ids: at most that many, so small enough to broadcast."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)
