"""Time grids, as-of sampling, thinning and retiming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.numeric import half_up
from cutline.operators import intervals as B
from cutline.plans import scan as S
from cutline.plans.expand import series

KEY = ["asset_id"]
def uniform_grid(keep: DataFrame, step_us: int, end_slack_us: int = 100) -> DataFrame:
    """Times st, st + step, ... in each kept range, below en - end_slack."""
    if step_us <= 0:
        raise ValueError("step_us must be positive")
    span = F.col("en_us") - end_slack_us - F.col("st_us")
    count = F.when(span > 0, F.floor((span + step_us - 1) / step_us)).otherwise(0)
    return series(keep, count, "i").select(
        "asset_id", (F.col("st_us") + F.col("i") * step_us).alias("t_us")
    )


def grid_count(keep: DataFrame, step_us: int, end_slack_us: int = 100) -> DataFrame:
    """Number of grid points per asset, without making them."""
    span = F.col("en_us") - end_slack_us - F.col("st_us")
    count = F.when(span > 0, F.expr(f"(en_us - {end_slack_us} - st_us + {step_us} - 1) div {step_us}"))
    return keep.groupBy(*KEY).agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"))


def even_grid(keep: DataFrame, n: int) -> DataFrame:
    """Exactly n source times per asset, centred in n equal slices of kept time."""
    if n < 2:
        raise ValueError("a grid needs at least 2 points")
    return _even(keep, F.lit(n))


def even_grid_at_rate(keep: DataFrame, fps: float) -> DataFrame:
    """As `even_grid`, with max(2, round(fps * kept seconds)) times for each asset."""
    return _even(keep, F.greatest(F.lit(2).cast("bigint"), half_up(F.col("total") * F.lit(fps / 1e6))))


def _even(keep: DataFrame, n: Column) -> DataFrame:
    total = keep.groupBy(*KEY).agg(F.sum(F.col("en_us") - F.col("st_us")).alias("total"))
    points = series(total.withColumn("n", n.cast("bigint")), F.col("n"), "i").select(
        "asset_id", F.col("i").alias("sample_id"),
        F.expr("total * (2 * i + 1) div (2 * n)").alias("o_us"),
    )
    return B.from_output_time(points, keep).withColumnRenamed("sample_id", "i")


def asof_sample(
    grid: DataFrame, samples: DataFrame, assets: DataFrame | None = None, cap_us: int = 1_000
) -> DataFrame:
    """For each grid time the sample shown then: the latest with t <= time.

    With `assets` the time is first capped at `end_us - cap_us`.
    """
    if assets is not None:
        ends = assets.select("asset_id", F.col("end_us").alias("__end"))
        capped = F.least("t_us", F.col("__end") - cap_us)
        grid = grid.join(ends, KEY).withColumn("at_us", capped).drop("__end")
    else:
        grid = grid.withColumn("at_us", F.col("t_us"))
    shown = samples.select(
        "asset_id", F.col("t_us").alias("at_us"), "sample_id", F.lit(0).alias("side")
    )
    asked = grid.select("asset_id", "at_us", "t_us", F.lit(1).alias("side"))
    both = shown.unionByName(asked, allowMissingColumns=True)
    return (
        S.Scan(both, KEY, ["at_us", "side", "sample_id", "t_us"])
        .run(shown_id=S.last_value(F.col("sample_id")))
        .df.where("side = 1")
        .select("asset_id", "t_us", F.col("shown_id").alias("sample_id"))
    )


def take_every(samples: DataFrame, k: int) -> DataFrame:
    """Every k-th sample per asset; assets left with fewer than 2 are dropped."""
    enough = samples.groupBy(*KEY).count().where(F.col("count") > k).select(*KEY)
    return (
        S.Scan(samples, KEY, ["t_us", "sample_id"])
        .run(i=S.row_index())
        .df.where(F.col("i") % k == 0)
        .join(enough, KEY, "left_semi")
    )


def mark_keyframes(samples: DataFrame, out_fps: float) -> DataFrame:
    """Adds key_frame: true on every max(1, round(2 fps))-th sample."""
    gop = max(1, int(2 * out_fps + 0.5))
    return (
        S.Scan(samples, KEY, ["t_us", "sample_id"])
        .run(i=S.row_index())
        .df.withColumn("key_frame", F.col("i") % gop == 0)
    )


def retime(
    variants: DataFrame, mode: str, duration_s: float = 3.0, speed: float = 1.0
) -> DataFrame:
    """Adds delay_cs, shown_fps and total_s to variants(n, base_delay_cs, ...)."""
    if mode == "duration":
        raw = F.lit(100.0 * duration_s) / F.col("n")
    elif mode == "speed":
        raw = F.col("base_delay_cs") / F.lit(float(speed))
    else:
        raise ValueError(f"unknown timing mode {mode!r}")
    delay = F.greatest(F.lit(1).cast("bigint"), half_up(F.greatest(F.lit(1.0), raw)))
    return (
        variants.withColumn("delay_cs", delay)
        .withColumn("shown_fps", F.lit(100.0) / F.col("delay_cs"))
        .withColumn("total_s", F.col("n") * F.col("delay_cs") / F.lit(100.0))
    )


def ticks_to_us(samples: DataFrame) -> DataFrame:
    """Adds t_us and dur_us from cts, dur and timescale."""
    def micros(ticks: str) -> Column:
        return half_up(F.col(ticks) / F.col("timescale") * F.lit(1e6))

    return samples.withColumn("t_us", micros("cts")).withColumn("dur_us", micros("dur"))


def estimate_fps(samples: DataFrame) -> DataFrame:
    """Samples per second of each track: count over span plus the last duration."""
    span = F.max("t_us") - F.min("t_us") + F.coalesce(F.max_by("dur_us", F.struct("t_us", "sample_id")), F.lit(0))
    out = samples.groupBy("asset_id", "track").agg(
        F.count("*").alias("nb_samples"), span.alias("span_us")
    )
    fps = F.when(F.col("span_us") > 0, F.col("nb_samples") * 1e6 / F.col("span_us"))
    return out.withColumn("fps", fps)


def restamp(samples: DataFrame, keep: DataFrame, interval_us: int) -> DataFrame:
    """Kept samples with output time and a duration (missing -> one interval)."""
    return (
        B.to_output_time(samples, keep)
        .where("kept")
        .withColumn("dur_us", F.coalesce("dur_us", F.lit(interval_us).cast("bigint")))
        .drop("kept")
    )
