"""A stream that has ended loses none of its newest rows."""

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline import suite
from cutline.streaming import live
from test_streaming import HOUR, SF, SLIM, SLIM_SCHEMA, rows_of


def test_kept_samples_of_the_last_hour(spark):
    """The table and the stream keep the same samples, those the watermark has not passed included."""
    both = [rows_of(suite.queries()[name](spark, SF).select(*SLIM, "out_us")) for name in ("j6_kept_samples", "j6_stream_kept_samples")]
    assert both[0] == both[1]


def test_held_rows_follow_the_state(spark, tmp_path):
    """Rows still held over several batches are thinned from the stored threshold, or from none."""
    for rows in ([(1, 1, 1), (1, 2, 5), (2, 3, 100)], [(1, 4, 96), (1, 5, 97), (3, 6, 99), (2, 7, 101), (2, 8, 111)]):
        frame = spark.createDataFrame([(a, k, t * HOUR) for a, k, t in rows], SLIM_SCHEMA).withColumn("ts", F.timestamp_micros("t_us"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    thinned = live.stream_thin(stream, 10 * HOUR, 0, "20 hours")
    got = live.thin_to_end(thinned, "end", 10 * HOUR, 0)
    assert got.columns == stream.columns
    assert sorted(r.sample_id for r in got.collect()) == [1, 3, 4, 6, 8]
    assert got.where("ts <> timestamp_micros(t_us)").count() == 0
