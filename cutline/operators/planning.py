"""Planning tables: budgets, bitrates, variants, fallbacks, eviction, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.numeric import even, half_up
from cutline.plans import scan as S
from cutline.plans.stage import stage

FRAME_BYTES_LIMIT = 1.2e9
COMFORT_BYTES = 4e8


def cap_dims(
    jobs: DataFrame, max_edge: int | None = None, max_width: int | None = None,
    make_even: bool = False,
) -> DataFrame:
    """w and h limited by longest edge and by width (aspect kept), optionally even."""
    out = jobs
    one = F.lit(1).cast("bigint")
    if max_edge is not None:
        k = F.lit(float(max_edge)) / F.greatest("w", "h")
        k = F.when(F.greatest("w", "h") > max_edge, k).otherwise(1.0)
        out = out.withColumns(
            {c: F.greatest(one, half_up(F.col(c) * k)) for c in ("w", "h")}
        )
    if max_width is not None:
        k = F.lit(float(max_width)) / F.col("w")
        wide = F.col("w") > max_width
        out = out.withColumns(
            {
                "h": F.when(wide, F.greatest(one, half_up(F.col("h") * k))).otherwise(F.col("h")),
                "w": F.when(wide, F.lit(max_width).cast("bigint")).otherwise(F.col("w")),
            }
        )
    if make_even:
        out = out.withColumns({c: even(F.col(c)) for c in ("w", "h")})
    return out


def frame_budget(jobs: DataFrame, limit: float = FRAME_BYTES_LIMIT) -> DataFrame:
    """Adds bytes (n * w * h * 4), accepted, and a smaller size for rejected jobs."""
    size = F.col("n") * F.col("w") * F.col("h") * 4
    out = jobs.withColumn("bytes", size).withColumn("accepted", F.col("bytes") <= limit)
    floor = F.lit(64).cast("bigint")
    scale = F.sqrt(F.lit(COMFORT_BYTES) / F.col("bytes"))
    width = F.greatest(floor, half_up(F.col("w") * scale / 16) * 16)
    out = out.withColumn("fit_w", F.when(~F.col("accepted"), width))
    height = F.greatest(floor, half_up(F.col("fit_w") * F.col("h") / F.col("w")))
    return out.withColumn("fit_h", F.when(~F.col("accepted"), height))


def budget_totals(budget: DataFrame) -> DataFrame:
    return budget.groupBy("accepted").agg(
        F.count("*").alias("jobs"), F.sum("n").alias("frames"), F.sum("bytes").alias("bytes")
    )


def bitrate_plan(
    jobs: DataFrame, audio_bps: int = 128_000, keep_audio: bool = True
) -> DataFrame:
    """Adds video_bps and est_bytes.

    Mode "size" aims at target_mb less 3 % headroom and audio, at least 100 kb/s;
    mode "bitrate" takes target_mb as megabits per second.
    """
    dur = F.col("dur_us") / F.lit(1e6)
    audio = F.lit(audio_bps / 8 if keep_audio else 0.0) * dur
    room = F.greatest(F.lit(0.0), F.col("target_mb") * F.lit(1048576.0) * F.lit(0.97) - audio)
    by_size = F.greatest(F.lit(100_000).cast("bigint"), half_up(room * 8 / dur))
    by_rate = half_up(F.col("target_mb") * F.lit(1e6))
    out = jobs.withColumn("video_bps", F.when(F.col("mode") == "bitrate", by_rate).otherwise(by_size))
    return out.withColumn("est_bytes", half_up(F.col("video_bps") / 8 * dur + audio))


# Quality tiers (frame-rate divisor, quality factor) and formats.
TIERS = [("high", 1, 1.0), ("medium", 2, 1.0), ("small", 2, 0.75)]
FORMATS = ["gif", "webp", "apng"]
APNG_COLORS = {"high": 0, "medium": 256, "small": 64}


def expand_variants(jobs: DataFrame) -> DataFrame:
    """Jobs x formats x tiers without repeats.

    A variant under 2 frames is dropped, and so is one whose frame count and
    quality an earlier tier already has.  Three tiers fit in a row, so the rule is
    an array filter and nothing is shuffled.
    """
    def tier(i: int, fmt: str) -> str:
        key, div, mul = TIERS[i]
        quality = (
            f"cast({APNG_COLORS[key]} as bigint)" if fmt == "apng"
            else f"greatest(1L, least(100L, cast(floor(quality * {mul}D + 0.5D) as bigint)))"
        )
        return (
            f"struct('{fmt}' as fmt, {i} as tier_ord, '{key}' as tier,"
            f" cast((n + {div - 1}) div {div} as bigint) as frames, {quality} as q,"
            f" fps / {float(div)}D as eff_fps)"
        )

    picked = []
    for fmt in FORMATS:
        tiers = ", ".join(tier(i, fmt) for i in range(len(TIERS)))
        picked.append(
            f"""filter(filter(array({tiers}), t -> t.frames >= 2), (t, i) -> not exists(
                slice(filter(array({tiers}), u -> u.frames >= 2), 1, i),
                u -> u.frames = t.frames and u.q = t.q))"""
        )
    rows = jobs.withColumn("v", F.expr(f"explode(concat({', '.join(picked)}))"))
    return rows.select(
        "job_id", "v.fmt", "v.tier", "v.frames", F.col("v.q").alias("quality"), "v.eff_fps", "w", "h"
    )


# Encoder options per codec, best first, and acceleration modes.
LADDER = {
    "avc": [
        "avc1.640034", "avc1.640033", "avc1.640032", "avc1.64002a", "avc1.640029", "avc1.640028",
        "avc1.64001f", "avc1.4d0028", "avc1.42001f",
    ],
    "hevc": [
        "hvc1.1.6.L186.B0", "hvc1.1.6.L156.B0", "hvc1.1.6.L153.B0", "hvc1.1.6.L150.B0",
        "hvc1.1.6.L123.B0", "hvc1.1.6.L120.B0", "hvc1.1.6.L93.B0",
        "hev1.1.6.L153.B0", "hev1.1.6.L123.B0",
    ],
}
MAX_OPTIONS = 1024
ACCELS = ["prefer-hardware", "no-preference"]


def first_supported(requests: DataFrame, supports: DataFrame) -> DataFrame:
    """The first option of each request's codec that takes its size.

    supports(codec, accel_rank, rank, option, max_w, max_h); acceleration counts
    before rank.  With none, `advice` says whether the other codec would do.

    While there are at most MAX_OPTIONS options, requests look them up in one short
    broadcast list per codec.  Beyond that `_first_by_levels` finds them by sorting.
    """
    if supports.limit(MAX_OPTIONS + 1).count() > MAX_OPTIONS:
        return _first_by_levels(requests, supports)
    lists = supports.groupBy("codec").agg(
        F.array_sort(
            F.collect_list(F.struct("accel_rank", "rank", "option", "max_w", "max_h"))
        ).alias("options")
    )

    def first(col: str) -> str:
        return f"get(filter({col}, o -> o.max_w >= w and o.max_h >= h), 0)"

    own = lists.withColumnRenamed("options", "own_options")
    alt = lists.select(F.col("codec").alias("alt_codec"), F.col("options").alias("alt_options"))
    return (
        requests.withColumn("alt_codec", _other_codec())
        .join(F.broadcast(own), "codec", "left")
        .join(F.broadcast(alt), "alt_codec", "left")
        .withColumns(
            {"hit": F.expr(first("own_options")), "alt_hit": F.expr(first("alt_options"))}
        )
        .select(*requests.columns, *_advice())
    )


def _other_codec() -> Column:
    return F.when(F.col("codec") == "hevc", "avc").otherwise("hevc")


def _advice() -> list[Column]:
    return [
        F.col("hit.option").alias("option"),
        F.when(F.col("hit.accel_rank") == 0, ACCELS[0])
        .when(F.col("hit.accel_rank") == 1, ACCELS[1]).alias("accel"),
        F.when(F.col("hit").isNotNull(), "ok")
        .when(F.col("alt_hit").isNotNull(), F.concat(F.lit("switch to "), "alt_codec"))
        .otherwise("pick a smaller size").alias("advice"),
    ]


def _first_by_levels(requests: DataFrame, supports: DataFrame) -> DataFrame:
    """The same by dominance lookup: no size meets an option it does not choose.

    A codec's options are numbered by `max_w`; level k cuts the numbers into blocks of 2^k.
    Those wide enough for a request are a suffix of the numbers, hence at most one block of
    each level.  In a block the options by falling `max_h`, with the best place so far, are
    a staircase; all requests of the block are sorted into it by their `h` and read the step
    they stand on.  With n options and m sizes that is (n + m) log n rows in one scan.
    """
    place = ["accel_rank", "rank", "option", "max_w", "max_h"]
    options = stage(S.Scan(supports.select("codec", *place), ["codec"], place).run(place=S.row_index()).df, "options")
    ranked = stage(
        S.Scan(options.where("max_w is not null and max_h is not null").select("codec", "place", "max_w", "max_h"),
               ["codec"], ["max_w", "place"]).run(i=S.row_index()).df, "ranked")
    levels = int(ranked.agg(F.max("i")).first()[0] or 0).bit_length()

    wanted = requests.select("codec", "w", "h").where("w is not null and h is not null")
    sizes = wanted.unionByName(wanted.withColumn("codec", _other_codec())).distinct()
    nothing = F.lit(None).cast("long")
    along = ranked.select("codec", F.col("max_w").cast("double").alias("at"), F.lit(1).alias("kind"), nothing.alias("w"), nothing.alias("h"))
    asked = sizes.select("codec", F.col("w").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("w").cast("long"), F.col("h").cast("long"))
    narrower = S.Scan(along.unionByName(asked), ["codec"], ["at", "kind", "h"]).run(p=S.running_sum(F.col("kind").cast("long")))
    asks = narrower.df.where("kind = 0").select("codec", "w", "h", "p")

    block = ["codec", "level", "block"]
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    steps = ranked.select("codec", "i", "max_h", "place", level).select(
        "codec", "level", F.expr("shiftright(i, level)").alias("block"), (-F.col("max_h").cast("double")).alias("at"),
        F.lit(0).alias("kind"), (-F.col("place")).alias("best"), nothing.alias("w"), nothing.alias("h"))
    later = F.array(F.struct(F.lit(0).alias("level"), F.col("p").alias("block")), *(
        F.when(F.expr(f"(shiftright(p, {k}) & 1) = 0"), F.struct(
            F.lit(k).alias("level"), F.expr(f"shiftright(p, {k}) + 1").alias("block"))) for k in range(levels)))
    reads = asks.select("codec", "w", "h", F.explode(F.array_compact(later)).alias("b")).select(
        "codec", "b.level", "b.block", (-F.col("h").cast("double")).alias("at"), F.lit(1).alias("kind"),
        nothing.alias("best"), "w", "h")
    stairs = S.Scan(steps.unionByName(reads), block, ["at", "kind", "w", "best"]).run(top=S.running_max(F.col("best")))
    first = (
        stairs.df.where("kind = 1").groupBy("codec", "w", "h").agg((-F.max("top")).alias("place"))
        .join(options, ["codec", "place"])
        .select("codec", "w", "h", F.struct("accel_rank", "rank", "option").alias("hit"))
    )
    first = stage(first, "first")
    other = first.select(F.col("codec").alias("alt_codec"), "w", "h", F.col("hit").alias("alt_hit"))
    return (
        requests.withColumn("alt_codec", _other_codec())
        .join(first, ["codec", "w", "h"], "left").join(other, ["alt_codec", "w", "h"], "left")
        .select(*requests.columns, *_advice())
    )


def size_report(runs: DataFrame) -> DataFrame:
    """Runs, bytes before and after, and their ratio per format and tier."""
    return runs.groupBy("fmt", "tier").agg(
        F.count("*").alias("runs"), F.sum("src_bytes").alias("src_bytes"),
        F.sum("out_bytes").alias("out_bytes"),
        (F.sum("src_bytes") / F.sum("out_bytes")).alias("ratio"),
    )


def evict_cold(items: DataFrame, keep_n: int = 24) -> DataFrame:
    """items(doc_id, item_id, last_seen, visible): what to drop so keep_n remain.

    Only invisible items go, least recently seen first.  Both sides of the join grow with the
    documents, so neither is broadcast; adaptive execution splits a hot document.
    """
    over = items.groupBy("doc_id").agg(F.count("*").alias("total")).where(F.col("total") > keep_n)
    cold = S.Scan(items.where(~F.col("visible")), ["doc_id"], ["last_seen", "item_id"]).run(
        ix=S.row_index()
    )
    return (
        cold.df.join(over.hint("merge"), "doc_id")
        .where(F.col("ix") < F.col("total") - keep_n)
        .select("doc_id", "item_id", "last_seen")
    )


def restore_settings(files: DataFrame, settings: DataFrame) -> DataFrame:
    """files(name, size, mtime) with the saved settings that apply to each.

    settings has the same key, one row each, general columns g_* and timeline columns
    t_*.  The
    same file gets everything; any other file gets the general part of the latest
    saved project, a single row read as a scalar subquery.
    """
    key = ["name", "size", "mtime"]
    general = [c for c in settings.columns if c.startswith("g_")]
    latest = settings.agg(
        F.max_by(F.struct(*general), F.struct("mtime", "name")).alias("latest")
    ).scalar()
    own = settings.withColumn("same_file", F.lit(True))
    joined = files.join(own, key, "left").withColumn("__latest", latest)
    same = F.coalesce("same_file", F.lit(False))
    return joined.select(
        *files.columns, same.alias("same_file"),
        *[F.when(same, F.col(c)).otherwise(F.col(f"__latest.{c}")).alias(c) for c in general],
        *[c for c in settings.columns if c.startswith("t_")],
    )
