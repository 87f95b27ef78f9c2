"""Intermediate tables kept on shared storage.

A scan reads its input up to three times (rows, totals of split keys, split
points).  A result that feeds another scan is therefore written once, below the
folder the cluster names in `spark.checkpoint.dir`, and read back: lineage ends
there, lost executors recompute only what follows, columns stay prunable, and the
file size lets the planner decide on a broadcast by itself.  What was shuffled for it is
deleted as soon as it is written, not when the driver next collects garbage.

All tables of a session lie in one folder, which `drop_staged` deletes; results not yet
computed need it until then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_root(spark: SparkSession) -> str:
    """The shared folder of this session; where no folder is named, one in the warehouse.

    On a cluster a warehouse on the local disk is no shared folder, hence an error.
    """
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"
        alone = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        if not alone and (root.startswith("file:") or "://" not in root):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
    return f"{root}/cutline-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once and return the stored table."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table this session has staged."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
