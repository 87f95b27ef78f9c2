"""The first n rows of every key, without one task per hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_n(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """Rows ranked 1..n in `order` within `key`, the rank as column `rank`.

    Each key is ranked in SALTS parts first, so a hot key is spread over tasks for any n;
    at most SALTS * n rows of a key meet for the final rank.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    part = Window.partitionBy(*key, "__salt").orderBy(*order)
    whole = Window.partitionBy(*key).orderBy(*order)
    few = rows.withColumn("__salt", salt).withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= n)
    return few.drop("__salt").withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
