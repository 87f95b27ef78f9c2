"""Rows that stand for ranges, expanded without long arrays or heavy tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 1 << 16


def series(df: DataFrame, count: Column, name: str) -> DataFrame:
    """Rows 0..count-1 per input row.

    Expanded in two steps: few block rows first, which are spread over tasks, then
    their contents.  So neither an array nor a task grows with the length of a range
    or with the number of ranges of an asset.
    """
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {_BLOCK}"))
    inner = F.sequence(
        F.col("__b") * _BLOCK, F.least(F.col("__n"), (F.col("__b") + 1) * _BLOCK) - 1
    )
    return (
        df.withColumn("__n", count.cast("bigint"))
        .where("__n > 0")
        .withColumn("__b", F.explode(blocks))
        .repartition(*df.columns, "__b")
        .withColumn(name, F.explode(inner))
        .drop("__n", "__b")
    )
