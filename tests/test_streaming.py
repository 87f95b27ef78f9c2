"""Live operators over several micro-batches equal their table forms."""

import tempfile

import pytest
from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import events as J
from cutline.operators import thinning
from cutline.streaming import live

SF = "/root/testdata/sf0.001"
SLIM = ["asset_id", "sample_id", "t_us"]
SLIM_SCHEMA = "asset_id long, sample_id long, t_us long"


HOUR = 3_600_000_000


def written(spark, order, files=4):
    """Samples in files that arrive one per micro-batch, dealt in equal steps of `order`."""
    rows = X.samples(spark, SF).withColumn("ts", F.timestamp_micros("t_us"))
    rows = rows.withColumn("edit_key", F.when(F.col("event_type") != "signup", F.col("event_type")))
    rows = rows.withColumn("order", order).cache()
    folder = tempfile.mkdtemp(prefix="cutline-stream-")
    lo, hi = rows.agg(F.min("order"), F.max("order")).first()
    step = (hi - lo) // files + 1
    for i in range(files):
        part = rows.where((F.col("order") >= lo + i * step) & (F.col("order") < lo + (i + 1) * step))
        part.drop("order").coalesce(1).write.mode("append").parquet(folder)
    rows.unpersist()
    table = spark.read.parquet(folder)
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "1").parquet(folder)


@pytest.fixture(scope="module")
def source(spark):
    """Files in time order."""
    return written(spark, F.col("t_us"))


@pytest.fixture(scope="module")
def mixed(spark):
    """Rows arrive up to two days after their turn: batches overlap, and order inside them is lost."""
    return written(spark, F.col("t_us") + F.pmod(F.xxhash64("sample_id"), F.lit(48)) * HOUR, 6)


@pytest.fixture(params=["source", "mixed"])
def arrival(request):
    return request.getfixturevalue(request.param)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def passed(table, lateness_us):
    """The watermark after all rows."""
    return (table.agg(F.max("t_us")).first()[0] // 1000 - lateness_us // 1000) * 1000


def test_thin(spark, arrival):
    table, stream = arrival
    got = live.run_to_table(live.stream_thin(stream.select(*SLIM, "ts"), X.GAP_36000S, 0, "50 hours"), "thin")
    want = thinning.throttle(table.select(*SLIM), X.GAP_36000S)
    assert rows_of(got.select(*SLIM)) == rows_of(want.where(F.col("t_us") < passed(table, 50 * HOUR)))


def test_coalesce(spark, arrival):
    table, stream = arrival
    cols = [*SLIM, "edit_key"]
    got = live.run_to_table(live.stream_coalesce(stream.select(*cols, "ts"), X.GAP_6H, "50 hours"), "coalesce")
    want = J.coalesce_edits(table.select(*cols), X.GAP_6H).where(F.col("t_us") < passed(table, 50 * HOUR))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_latest_pending(spark, arrival):
    table, stream = arrival
    done = (F.col("event_type") == "purchase").alias("done")
    wanted = F.col("event_type").isin("click", "view", "purchase")
    got = live.run_to_table(
        live.stream_latest_pending(stream.where(wanted).select(*SLIM, done, "ts"), "50 hours"), "pending"
    )
    want = J.latest_pending(
        table.where(F.col("event_type").isin("click", "view")).select(*SLIM),
        table.where("event_type = 'purchase'").select(*SLIM),
    ).where(F.col("issued_us") < passed(table.where(wanted), 50 * HOUR))
    assert rows_of(got) == rows_of(want.select(*got.columns))


def test_late_rows_are_dropped_and_others_stay_in_order(spark, tmp_path):
    """With no lateness 250 still comes before its batch's watermark has moved; 200 is late and gone."""
    for times in ([100, 50, 300], [250, 400, 350], [900, 200]):
        rows = [(1, t, t * HOUR) for t in times]
        frame = spark.createDataFrame(rows, SLIM_SCHEMA).withColumn("ts", F.timestamp_micros("t_us"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    got = live.run_to_table(live.stream_thin(stream, 60 * HOUR, 0, "0 seconds"), "late")
    assert sorted(r.sample_id for r in got.collect()) == [50, 250, 350]


def test_state_is_empty_after_expiry(spark, tmp_path):
    """Far later rows of another key move the watermark: the first keys leave no row and no state."""
    spark.conf.set(live.STATE_STORE, live.SETTINGS[live.STATE_STORE])
    first = [(a, k, k * HOUR, k % 2 == 1) for a in range(5) for k in range(20)]
    for rows in (first, [(9, 99, 5000 * HOUR, True)], [(9, 100, 9000 * HOUR, True)]):
        frame = spark.createDataFrame(rows, SLIM_SCHEMA + ", done boolean").withColumns(
            {"ts": F.timestamp_micros("t_us"), "edit_key": F.lit("k")})
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, form in (
        ("thin", lambda s: live.stream_thin(s.select(*SLIM, "ts"), HOUR, 0)),
        ("coalesce", lambda s: live.stream_coalesce(s.select(*SLIM, "edit_key", "ts"), HOUR)),
        ("pending", lambda s: live.stream_latest_pending(s.select(*SLIM, "done", "ts"))),
    ):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
        query = (form(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}")
                 .option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start())
        query.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/{name}").where("asset_id < 9").count() > 0
        states = spark.read.format("statestore").option("path", f"{tmp_path}/{name}-state")
        left = {r.key.asset_id for r in states.option("stateVarName", "state").load().collect()}
        held = {r.key.asset_id for r in states.option("stateVarName", "held").load().collect()}
        assert not left & set(range(5)) and held <= {9}, name


def test_events_in_a_folder_or_a_file(spark, tmp_path):
    """A folder of part files, as a cluster writes it, streams the same rows as one file."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("part-*")).rename(tmp_path / "file" / "events.parquet")
    want = rows_of(X.samples(spark, SF).select(*SLIM))
    for name in ("folder", "file"):
        got = live.run_to_table(live.sample_stream(spark, f"{tmp_path}/{name}"), "read")
        assert rows_of(got.select(*SLIM)) == want, name


def test_debounce(spark, source):
    """Bursts the final watermark has passed; the rest is still waiting."""
    table, stream = source
    got = live.run_to_table(live.stream_debounce(stream, "6 hours", "1 hour"), "debounce")
    want = J.debounce(table.select(*SLIM), X.GAP_6H).select(*got.columns)
    got, want = rows_of(got), rows_of(want)
    assert got and set(got) <= set(want)
    last = max(r[2] for r in want)
    quiet = [r for r in want if r[3] < last - 2 * X.GAP_6H]
    assert set(quiet) <= set(got)


def test_superseded_in_a_merge_table(spark, source, tmp_path):
    """Several batches, a restart and a repeated batch give the best result per key, ordered by token."""
    table, _ = source
    cols = ["asset_id", "event_type", F.pmod(F.xxhash64("sample_id"), F.lit(1 << 40)).alias("token"), "t_us"]
    rows = table.select(*cols)
    key = ["asset_id", "event_type"]
    merged = live.MergeTable(spark, f"{tmp_path}/table", key, "token", buckets=4)
    assert merged.read(rows.schema).count() == 0
    for part in range(3):
        rows.where(F.pmod("token", F.lit(3)) == part).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
        live.superseded_to_table(stream, merged, f"{tmp_path}/state").awaitTermination()
        seen = spark.read.parquet(f"{tmp_path}/in")
        want = rows_of(J.drop_superseded(seen, key).select(*rows.columns))
        assert rows_of(merged.read(rows.schema)) == want
    newest = max(int(p.name.split("-")[1]) for p in (tmp_path / "table" / "lists").iterdir())
    merged.merge(rows.where(F.pmod("token", F.lit(3)) == 2), newest)  # the last batch again, as after a failure
    assert rows_of(merged.read(rows.schema)) == want


def test_touched_buckets_only_are_rewritten(spark, tmp_path):
    merged = live.MergeTable(spark, str(tmp_path), ["k"], "token", buckets=8)
    merged.merge(spark.createDataFrame([(k, 1, "a") for k in range(50)], "k long, token long, v string"), 0)
    merged.merge(spark.createDataFrame([(7, 2, "b"), (8, 0, "late")], "k long, token long, v string"), 1)
    assert len(list((tmp_path / "rows" / "v-1").glob("bucket=*"))) <= 2
    got = {r.k: (r.token, r.v) for r in merged.read("k long, token long, v string").collect()}
    assert len(got) == 50 and got[7] == (2, "b") and got[8] == (1, "a")


def test_many_ranges_on_one_day(spark, tmp_path):
    """100 000 kept ranges of one asset: every table of the index has one row per key, and the rows are right."""
    n = 100_000
    assets = spark.createDataFrame([(1, 0, 2 * n * 400)], "asset_id long, in_us long, out_us long")
    keep = spark.range(n).select(F.lit(1).cast("long").alias("asset_id"), (F.col("id") * 800).alias("st_us"),
                                 (F.col("id") * 800 + 400).alias("en_us"))
    *upper, leaves = live.range_index(assets, keep, 1)
    assert len(upper) == 1
    for level in [*upper, leaves]:
        assert level.count() == level.select("asset_id", "node").distinct().count()
    assert leaves.select(F.max(F.size("ranges"))).first()[0] <= live.PER_NODE
    rows = spark.range(1, 20_000).select(
        F.lit(1).cast("long").alias("asset_id"), F.col("id").alias("sample_id"), (F.col("id") * 4001).alias("t_us"))
    rows.withColumn("ts", F.timestamp_micros("t_us")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    got = live.run_to_table(live.stream_kept_samples(stream, assets, keep, 1, 1, "0 seconds"), "kept")
    want = [(k, k * 4001 // 800 * 400 + k * 4001 % 800) for k in range(1, 20_000) if k * 4001 % 800 < 400 and k * 4001 < 2 * n * 400]
    newest = max(k for k, _ in want) * 4001 // 1000 * 1000
    assert sorted((r.sample_id, r.out_us) for r in got.collect()) == [(k, o) for k, o in want if k * 4001 < newest]


def test_superseded(spark, source):
    table, stream = source
    cols = ["asset_id", F.col("sample_id").alias("token"), "t_us"]
    query = (
        live.stream_superseded(stream.select(*cols), ["asset_id"], "token")
        .writeStream.format("memory").queryName("superseded").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = J.drop_superseded(table.select(*cols), ["asset_id"])
    assert rows_of(spark.table("superseded")) == rows_of(want)
