"""A stored table leaves no shuffle files of its making behind."""

import os
import time

from pyspark.sql import functions as F

from cutline.plans.stage import _CLEAN, stage


def shuffled(spark):
    """Bytes of shuffle files in the executors' own folders."""
    total = 0
    for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString():
        for path, _, files in os.walk(folder):
            total += sum(os.path.getsize(os.path.join(path, f)) for f in files if f.startswith("shuffle_") and f.endswith(".data"))
    return total


def test_shuffles_of_a_stored_table_are_deleted(spark):
    before, set_before = shuffled(spark), spark.conf.get(_CLEAN, None)
    rows = spark.range(400_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n"))
    stored = stage(rows, "counts")
    for _ in range(50):
        if shuffled(spark) <= before + 100_000:
            break
        time.sleep(0.2)
    assert shuffled(spark) <= before + 100_000
    assert spark.conf.get(_CLEAN, None) == set_before
    # the plan itself can be run again, before and after
    assert stored.count() == 400_000 == rows.count() == stage(rows, "again").count()
