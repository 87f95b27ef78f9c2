"""Text files with front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files below `path` as (path, content)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def front_matter(files: DataFrame) -> DataFrame:
    """(path, content) to (path, front map, body).

    Front matter lies between a first line "---" and the next such line; its
    `key: value` lines become map entries, the last one wins.  Files without it
    keep their whole text.
    """
    close = F.expr("if(startswith(content, '---\\n'), locate('\\n---\\n', content, 4), 0)")
    has = F.col("__close") > 0
    lines = F.split(F.expr("substring(content, 5, greatest(__close - 5, 0))"), "\n")
    pairs = F.transform(
        F.filter(lines, lambda s: F.instr(s, ":") > 0),
        lambda s: F.struct(
            F.trim(F.substring_index(s, ":", 1)).alias("key"),
            F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value"),
        ),
    )
    unique = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.key == p.key),
    )
    empty = F.expr("cast(map() as map<string,string>)")
    return files.withColumn("__close", close).select(
        "path",
        F.when(has, F.map_from_entries(unique)).otherwise(empty).alias("front"),
        F.when(has, F.expr("substring(content, __close + 5)")).otherwise(F.col("content")).alias("body"),
    )
