"""Saved projects: JSON settings to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "v int, file struct<name:string,size:bigint,lastModified:bigint>,"
    " general struct<fps:bigint,quality:bigint,timingMode:string>,"
    " video struct<cropStart:bigint,cropEnd:bigint,cuts:array<struct<start:double,`end`:double>>>"
)


def explode_projects(json_df: DataFrame, key: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """(settings, cuts) of the readable projects in json_df(key, json).

    Junk parses to nothing and is dropped; cuts need two finite ends.
    """
    doc = F.from_json("json", SCHEMA, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
    parsed = json_df.select(key, doc.alias("p")).where("p.general is not null")
    settings = parsed.select(
        key, "p.file.name", "p.file.size", F.col("p.file.lastModified").alias("mtime"),
        "p.general.fps", "p.general.quality", F.col("p.general.timingMode").alias("timing_mode"),
        F.col("p.video.cropStart").alias("crop_start"), F.col("p.video.cropEnd").alias("crop_end"),
    )
    finite = F.expr(
        """filter(p.video.cuts, c -> c.start is not null and c.`end` is not null
           and abs(c.start) < double('inf') and abs(c.`end`) < double('inf'))"""
    )
    cuts = parsed.select(key, F.explode(finite).alias("c")).select(
        key, F.col("c.start").cast("bigint").alias("st_us"), F.col("c.end").cast("bigint").alias("en_us")
    )
    return settings, cuts
