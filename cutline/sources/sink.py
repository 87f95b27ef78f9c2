"""Result tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists",
    rows_per_file: int = 5_000_000,
) -> None:
    """Parquet partitioned by `by`.

    Rows meet by partition value before writing, so tasks do not each open a file in
    every folder; a value with many rows is split over tasks by its size (a rebalance,
    which adaptive execution cuts at its advisory partition size).
    """
    (
        df.hint("rebalance", *by)
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*by).parquet(path)
    )
