"""Interval algebra on timelines.

assets(asset_id, in_us, out_us, ...), cuts(asset_id, st_us, en_us) and
samples(asset_id, sample_id, t_us, ...).  Intervals are half-open [st, en) in
integer microseconds (a deliberate change from float seconds).  Interval joins are
done by sorting boundaries and points together and carrying the last boundary
forward (`plans.scan`), so the work is n log n and a hot asset is split over tasks.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.plans import scan as S
from cutline.plans.stage import stage

MS = 1_000
KEY = ["asset_id"]
_FIRST = -(2**63)


def _clamped(assets: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts with their asset's bounds and the clamped ends a_us, b_us."""
    bounds = assets.select("asset_id", "in_us", "out_us")
    return cuts.join(bounds, KEY).withColumns(
        {
            "a_us": F.greatest(F.least("st_us", "out_us"), "in_us"),
            "b_us": F.greatest(F.least("en_us", "out_us"), "in_us"),
        }
    )


def clip_intervals(assets: DataFrame, cuts: DataFrame, min_us: int = MS) -> DataFrame:
    """Cuts limited to [in, out]; those no longer than `min_us` are dropped."""
    return (
        _clamped(assets, cuts)
        .where(F.col("b_us") - F.col("a_us") > min_us)
        .select("asset_id", F.col("a_us").alias("st_us"), F.col("b_us").alias("en_us"))
    )


def merge_intervals(cuts: DataFrame, tol_us: int = MS) -> DataFrame:
    """Union of overlapping or touching intervals.

    A row starts an island when it begins more than `tol_us` after everything
    before it ends.  The end of an island is the running maximum seen by the next
    island's first row, so only island starts travel to the second scan.
    """
    order = ["st_us", "en_us"]
    first = S.Scan(cuts.select("asset_id", *order), KEY, order).run(
        reach=S.running_max(F.col("en_us")),
        total=S.running_max(F.col("en_us"), inclusive=True),
    )
    starts = first.map(
        lambda d: d.withColumn(
            "is_start", F.col("reach").isNull() | (F.col("st_us") > F.col("reach") + tol_us)
        )
    )
    ended = starts.run(
        next_reach=S.next_value(F.when(F.col("is_start"), F.col("reach"))),
    ).df.where("is_start")
    last = cuts.groupBy(*KEY).agg(F.max("en_us").alias("max_en"))
    return ended.join(last, KEY).select(
        "asset_id", "st_us", F.coalesce("next_reach", "max_en").alias("en_us")
    )


def keep_ranges(assets: DataFrame, cuts: DataFrame) -> DataFrame:
    """[in, out] minus every cut.

    Each asset also gets an empty cut at `out`, so the tail range needs no second
    branch.  Clamping keeps the order of starts, hence the scan runs in raw order.
    """
    order = ["st_us", "en_us"]
    sentinel = assets.select(
        "asset_id", F.col("out_us").alias("st_us"), F.col("out_us").alias("en_us")
    )
    edges = cuts.select("asset_id", *order).unionByName(sentinel)
    cursor = F.coalesce("reach", "in_us")
    return (
        S.Scan(_clamped(assets, edges), KEY, order, split_source=cuts)
        .run(reach=S.running_max(F.col("b_us")))
        .df.where(F.col("a_us") > cursor)
        .select("asset_id", cursor.alias("st_us"), F.col("a_us").alias("en_us"))
    )


def kept_duration(assets: DataFrame, keep: DataFrame) -> DataFrame:
    """Total kept time per asset, 0 when nothing is kept."""
    total = keep.groupBy(*KEY).agg(F.sum(F.col("en_us") - F.col("st_us")).alias("kept_us"))
    return assets.select("asset_id").join(total, KEY, "left").select(
        "asset_id", F.coalesce("kept_us", F.lit(0).cast("bigint")).alias("kept_us")
    )


def floored_duration(
    assets: DataFrame, cuts: DataFrame, floor_us: int = 50_000
) -> DataFrame:
    """max(floor, (out - in) - sum of cuts).

    Overlapping cuts count twice, as in the planning estimate this follows; merge
    them first for the true value.
    """
    removed = cuts.groupBy(*KEY).agg(F.sum(F.col("en_us") - F.col("st_us")).alias("cut_us"))
    left = F.col("out_us") - F.col("in_us") - F.coalesce("cut_us", F.lit(0))
    return assets.join(removed, KEY, "left").select(
        "asset_id", F.greatest(F.lit(floor_us).cast("bigint"), left).alias("kept_us")
    )


def _along(ranges: DataFrame, at: str, points: DataFrame, time: str, ranges_first: bool, **ops):
    """Scan ranges and points together by position; returns the points.

    Ranges are placed at column `at` and carry their columns as struct `rng`, which
    `ops` may use.  At equal positions ranges come first or last.  Points travel
    with their payload only: key, id and time are the sort columns themselves.
    """
    fields = [c for c in ranges.columns if c != "asset_id"]
    payload = [c for c in points.columns if c not in ("asset_id", "sample_id", time)]
    r = ranges.select(
        "asset_id", F.col(at).alias("pos"), F.lit(0 if ranges_first else 2).alias("side"),
        F.struct(*fields).alias("rng"),
    )
    p = points.select(
        "asset_id", F.col(time).alias("pos"), F.lit(1).alias("side"), "sample_id", *payload
    )
    both = r.unionByName(p, allowMissingColumns=True)
    out = S.Scan(both, KEY, ["pos", "side", "sample_id"]).run(**ops).df.where("side = 1")
    return out.withColumnRenamed("pos", time).select(*points.columns, *ops)


def to_output_time(samples: DataFrame, keep: DataFrame) -> DataFrame:
    """Adds out_us, the time on the compacted timeline, and `kept`.

    One pass: the last range at or before the sample and the running length of
    ranges come out of the same scan.  Inside a cut the output time stands still.
    """
    length = F.col("rng.en_us") - F.col("rng.st_us")
    out = _along(
        keep.select("asset_id", "st_us", "en_us"), "st_us", samples, "t_us", True,
        hit=S.last_value(F.col("rng")), acc=S.running_sum(length, inclusive=True),
    )
    before = F.col("acc") - (F.col("hit.en_us") - F.col("hit.st_us"))
    inside = F.least(F.col("t_us"), F.col("hit.en_us")) - F.col("hit.st_us")
    return out.select(
        *samples.columns,
        F.coalesce(before + inside, F.lit(0)).alias("out_us"),
        F.coalesce(F.col("t_us") < F.col("hit.en_us"), F.lit(False)).alias("kept"),
    )


def accumulate(keep: DataFrame) -> DataFrame:
    """Kept ranges with acc_us, the output time at which each one begins."""
    return (
        S.Scan(keep.select("asset_id", "st_us", "en_us"), KEY, ["st_us", "en_us"])
        .run(acc_us=S.running_sum(F.col("en_us") - F.col("st_us")))
        .df
    )


def from_output_time(
    points: DataFrame, keep: DataFrame, assets: DataFrame | None = None
) -> DataFrame:
    """Adds t_us, the source time of output time o_us.

    The boundary between two ranges belongs to the earlier one; past the end the
    last range's end is used.  Assets without any range map to their `in_us` when
    `assets` is given, else to 0.
    """
    ranges = stage(accumulate(keep), "ranges")
    start = F.when(F.col("acc_us") == 0, F.lit(_FIRST)).otherwise(F.col("acc_us"))
    hit = _along(
        ranges.withColumn("from_us", start), "from_us", points, "o_us", False,
        hit=S.last_value(F.col("rng")),
    )
    inside = F.least(
        F.col("hit.st_us") + F.col("o_us") - F.col("hit.acc_us"), F.col("hit.en_us")
    )
    out = hit.select(*points.columns, inside.alias("t_us"))
    if assets is None:
        return out.withColumn("t_us", F.coalesce("t_us", F.lit(0).cast("bigint")))
    empty = assets.select("asset_id", F.col("in_us").alias("empty_us"))
    return (
        out.join(empty, KEY, "left")
        .withColumn("t_us", F.coalesce("t_us", "empty_us"))
        .drop("empty_us")
    )


def drop_cut_samples(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """Samples outside every cut: no cut begun so far ends after them."""
    out = _along(
        cuts.select("asset_id", "st_us", "en_us"), "st_us", samples, "t_us", True,
        reach=S.running_max(F.col("rng.en_us")),
    )
    return out.where("reach is null or reach <= t_us").drop("reach")


def trim_window(samples: DataFrame, assets: DataFrame, slack_us: int = 1) -> DataFrame:
    """Samples with in <= t < out; `slack_us` lets a sample be that much early."""
    bounds = assets.select("asset_id", "in_us", "out_us")
    t = F.col("t_us")
    return (
        samples.join(bounds, KEY)
        .where((t + slack_us >= F.col("in_us")) & (t < F.col("out_us")))
        .drop("in_us", "out_us")
    )


def prune_to_assets(stored: DataFrame, assets: DataFrame, time_col: str, slack_us: int = 1) -> DataFrame:
    """Rows of a stored table that some asset's trim window can hold, by its own time column.

    The smallest `in` and the largest `out` (one row to the driver) become literals on the column as
    it is stored, so they reach Parquet and whole files and row groups are skipped (integers and
    timestamps; Spark 4.1 applies filters on zone-less timestamps row by row).  The exact
    test per asset stays with `trim_window`.
    """
    lo, hi = assets.agg(F.min("in_us"), F.max("out_us")).first()
    if lo is None:
        return stored.where(F.lit(False))
    kind = stored.schema[time_col].dataType.simpleString()

    def literal(us: int) -> Column:
        if kind == "bigint":
            return F.lit(us)
        stamp = datetime(1970, 1, 1) + timedelta(microseconds=us)
        zone = "" if kind == "timestamp_ntz" else "+00:00"
        return F.expr(f"{kind} '{stamp.isoformat(sep=' ', timespec='microseconds')}{zone}'")

    t = F.col(time_col)
    return stored.where((t >= literal(lo - slack_us)) & (t < literal(hi)))


def snap_to_kept(
    points: DataFrame, assets: DataFrame, cuts: DataFrame, end_slack_us: int = 0
) -> DataFrame:
    """Adds snap_us: outside [in, out) -> in; inside a cut -> that cut's end.

    With several cuts around a point the first in start order counts.  A cut is
    first from where all earlier cuts have ended up to its own end, so the cuts
    become disjoint pieces by one running maximum and the rest is a lookup.
    With `end_slack_us` a point that close to a cut's end is left alone.
    """
    order = ["st_us", "en_us"]
    shut = F.col("en_us") - end_slack_us
    pieces = (
        S.Scan(cuts.select("asset_id", *order), KEY, order)
        .run(reach=S.running_max(shut))
        .df.select(
            "asset_id",
            F.greatest("st_us", "reach").alias("from_us"),
            shut.alias("to_us"),
            F.col("en_us").alias("end_us"),
        )
        .where("to_us > from_us")
    )
    pieces = stage(pieces, "pieces")
    hit = _along(pieces, "from_us", points, "t_us", True, hit=S.last_value(F.col("rng")))
    inside = F.when(F.col("t_us") < F.col("hit.to_us"), F.col("hit.end_us"))
    bounds = assets.select("asset_id", "in_us", "out_us")
    out_of_range = (F.col("t_us") >= F.col("out_us")) | (F.col("t_us") < F.col("in_us"))
    snapped = F.when(out_of_range, F.col("in_us")).otherwise(F.coalesce(inside, "t_us"))
    return (
        hit.join(bounds, KEY)
        .withColumn("snap_us", snapped)
        .select(*points.columns, "snap_us")
    )


def intervals_from_marks(events: DataFrame, min_us: int = MS) -> DataFrame:
    """Cuts built from arm / commit / clear marks.

    Every mark overwrites the armed time, so a commit closes a cut exactly when
    the mark before it is an arm.  `live` is false for cuts a later clear removed.
    """
    order = ["t_us", "sample_id"]
    rows = S.Scan(events.select("asset_id", *order, "act"), KEY, order).run(
        prev=S.previous_row(F.struct("act", "t_us")),
        cleared=S.next_value(F.when(F.col("act") == "clear", F.col("t_us"))),
    ).df
    armed = F.col("prev.t_us")
    return (
        rows.where((F.col("act") == "commit") & (F.col("prev.act") == "arm"))
        .select(
            "asset_id",
            F.least(armed, "t_us").alias("st_us"),
            F.greatest(armed, F.col("t_us")).alias("en_us"),
            F.col("cleared").isNull().alias("live"),
        )
        .where(F.col("en_us") - F.col("st_us") > min_us)
    )


def segment_timeline(assets: DataFrame, cuts: DataFrame) -> DataFrame:
    """The whole of [start, end] labelled outside / keep / cut."""
    def label(df: DataFrame, name: str) -> DataFrame:
        return df.select("asset_id", "st_us", "en_us", F.lit(name).alias("label"))

    ends = F.array(
        F.struct(F.col("start_us").alias("st_us"), F.col("in_us").alias("en_us")),
        F.struct(F.col("out_us").alias("st_us"), F.col("end_us").alias("en_us")),
    )
    outside = assets.select("asset_id", F.inline(ends)).where("en_us > st_us")
    return (
        label(outside, "outside")
        .unionByName(label(keep_ranges(assets, cuts), "keep"))
        .unionByName(label(clip_intervals(assets, cuts, 0), "cut"))
    )


def kept_samples(samples: DataFrame, assets: DataFrame, cuts: DataFrame) -> DataFrame:
    """Samples that survive trim and cuts, with their compacted time."""
    return (
        to_output_time(samples, stage(keep_ranges(assets, cuts), "keep"))
        .where("kept")
        .drop("kept")
    )
