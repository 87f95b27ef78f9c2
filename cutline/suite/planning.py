"""Registered queries of the planning family with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import planning as G
from cutline.operators.sampling import retime
from cutline.sources import projects

JOB = ["job_id", "n", "w", "h"]


def support_rows() -> list[tuple]:
    """Options with caps that shrink down the ladder; hardware stops at 1920 x 1088."""
    rows = []
    for codec, options in G.LADDER.items():
        for rank, option in enumerate(options):
            w, h = 2560 - 240 * rank, 1600 - 150 * rank
            rows.append((codec, 0, rank, option, min(w, 1920) - 640, min(h, 1088)))
            rows.append((codec, 1, rank, option, w + (320 if codec == "hevc" else 0), h))
    return rows


def _supports(s):
    return s.createDataFrame(
        support_rows(),
        "codec string, accel_rank int, rank int, option string, max_w int, max_h int",
    )


def _requests(s, d):
    return X.jobs(s, d).select("job_id", "codec", "w", "h")


def _runs(s, d):
    jobs = X.jobs(s, d)
    variants = G.expand_variants(jobs)
    src = jobs.select("job_id", (F.col("n") * F.col("w") * F.col("h") * 4).alias("src_bytes"))
    out = F.expr("frames * w * h * (quality + 20) div 100")
    return variants.join(src, "job_id").withColumn("out_bytes", out)


def _report(s, d):
    return G.size_report(_runs(s, d)).withColumn("ratio", F.round("ratio", 9))


def _seen(s, d):
    return X.samples(s, d).selectExpr(
        "asset_id as doc_id", "sample_id as item_id", "t_us as last_seen", "k % 10 = 0 as visible"
    )


def _restored(s, d):
    settings, _ = projects.explode_projects(X.projects(s, d))
    saved = settings.selectExpr(
        "name", "size", "mtime", "fps as g_fps", "quality as g_quality",
        "crop_start as t_start", "crop_end as t_end",
    )
    files = X.assets(s, d).selectExpr(
        "concat('asset', asset_id) as name",
        "duration_us + if(asset_id % 3 = 0, 1, 0) as size", "start_us as mtime",
    )
    return G.restore_settings(files, saved)


def _retimed(s, d):
    """Variants with the delay they play at, one and a half times as fast."""
    variants = G.expand_variants(X.jobs(s, d)).select(
        "job_id", "fmt", "tier", F.col("frames").alias("n"),
        (F.lit(100.0) / F.col("eff_fps")).alias("base_delay_cs"),
    )
    return retime(variants, "speed", speed=1.5).drop("base_delay_cs")


QUERIES = {
    "g1_cap_dims": lambda s, d: G.cap_dims(X.jobs(s, d).select(*JOB), 1200, 854, True),
    "g1_frame_budget": lambda s, d: G.frame_budget(X.jobs(s, d).select(*JOB)),
    "g1_budget_totals": lambda s, d: G.budget_totals(G.frame_budget(X.jobs(s, d))),
    "g2_bitrate_plan": lambda s, d: G.bitrate_plan(X.jobs(s, d)).select(
        "job_id", "mode", "video_bps", "est_bytes"
    ),
    "g3_expand_variants": lambda s, d: G.expand_variants(X.jobs(s, d)),
    "g3_retimed_variants": _retimed,
    "g4_first_supported": lambda s, d: G.first_supported(_requests(s, d), _supports(s)),
    "g5_size_report": _report,
    "g6_evict_cold": lambda s, d: G.evict_cold(_seen(s, d)),
    "g7_restore_settings": _restored,
}

_VARIANTS = """
    tiers AS (SELECT * FROM (VALUES (0, 'high', 1, 1.0::DOUBLE, 0), (1, 'medium', 2, 1.0::DOUBLE, 256),
                                    (2, 'small', 2, 0.75::DOUBLE, 64)) t(o, tier, div, mul, colors)),
    formats AS (SELECT unnest(['gif', 'webp', 'apng']) AS fmt),
    raw AS (
        SELECT job_id, fmt, o, tier, (n + div - 1) // div AS frames,
               CAST(CASE WHEN fmt = 'apng' THEN colors
                    ELSE greatest(1, least(100, floor(quality * mul + 0.5::DOUBLE))) END AS BIGINT) AS quality,
               fps / div::DOUBLE AS eff_fps, w, h, n
        FROM jobs, formats, tiers),
    variants AS (
        SELECT * FROM raw WHERE frames >= 2
        QUALIFY row_number() OVER (PARTITION BY job_id, fmt, frames, quality ORDER BY o) = 1)"""

_SUPPORT = "supports AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {a}, {r}, '{o}', {w}, {h})" for c, a, r, o, w, h in support_rows()
) + ") t(codec, accel_rank, rank, option, max_w, max_h))"

ORACLE = {
    "g1_cap_dims": X.with_tables("jobs", """
        WITH e AS (SELECT job_id, n, greatest(1, floor(w * k + 0.5::DOUBLE)) AS w,
                          greatest(1, floor(h * k + 0.5::DOUBLE)) AS h
                   FROM (SELECT *, CASE WHEN greatest(w, h) > 1200 THEN 1200.0::DOUBLE / greatest(w, h)
                                        ELSE 1.0::DOUBLE END AS k FROM jobs)),
        f AS (SELECT job_id, n, least(w, 854) AS w,
                     CASE WHEN w > 854 THEN greatest(1, floor(h * (854.0::DOUBLE / w) + 0.5::DOUBLE)) ELSE h END AS h
              FROM e)
        SELECT job_id, n, CAST(greatest(2, floor(w / 2 + 0.5::DOUBLE) * 2) AS BIGINT) AS w,
               CAST(greatest(2, floor(h / 2 + 0.5::DOUBLE) * 2) AS BIGINT) AS h FROM f"""),
    "g1_frame_budget": X.with_tables("jobs", """
        SELECT job_id, n, w, h, bytes, accepted, fit_w,
               CASE WHEN NOT accepted THEN CAST(greatest(64, floor(fit_w * h / w::DOUBLE + 0.5::DOUBLE)) AS BIGINT) END AS fit_h
        FROM (SELECT *, CASE WHEN NOT accepted THEN CAST(greatest(64,
                  floor(w * sqrt(4e8::DOUBLE / bytes) / 16 + 0.5::DOUBLE) * 16) AS BIGINT) END AS fit_w
              FROM (SELECT job_id, n, w, h, n * w * h * 4 AS bytes,
                           n * w * h * 4 <= 1.2e9::DOUBLE AS accepted FROM jobs))"""),
    "g1_budget_totals": X.with_tables("jobs", """
        SELECT n * w * h * 4 <= 1200000000 AS accepted, count(*) AS jobs,
               CAST(sum(n) AS BIGINT) AS frames, CAST(sum(n * w * h * 4) AS BIGINT) AS bytes
        FROM jobs GROUP BY 1"""),
    "g2_bitrate_plan": X.with_tables("jobs", """
        SELECT job_id, mode, video_bps,
               CAST(floor(video_bps / 8.0::DOUBLE * dur + 16000.0::DOUBLE * dur + 0.5::DOUBLE) AS BIGINT) AS est_bytes
        FROM (SELECT *, CASE WHEN mode = 'bitrate' THEN target_mb * 1000000
                ELSE greatest(100000, CAST(floor(greatest(0.0::DOUBLE,
                     target_mb * 1048576.0::DOUBLE * 0.97::DOUBLE - 16000.0::DOUBLE * dur)
                     * 8 / dur + 0.5::DOUBLE) AS BIGINT)) END AS video_bps
              FROM (SELECT *, dur_us / 1e6::DOUBLE AS dur FROM jobs))"""),
    "g3_expand_variants": X.with_tables("jobs", f"""
        WITH {_VARIANTS.strip()}
        SELECT job_id, fmt, tier, frames, quality, eff_fps, w, h FROM variants"""),
    "g3_retimed_variants": X.with_tables("jobs", f"""
        WITH {_VARIANTS.strip()},
        timed AS (SELECT job_id, fmt, tier, frames AS n, greatest(1, CAST(floor(greatest(1.0::DOUBLE,
                      100.0::DOUBLE / eff_fps / 1.5::DOUBLE) + 0.5::DOUBLE) AS BIGINT)) AS delay_cs
                  FROM variants)
        SELECT *, 100.0::DOUBLE / delay_cs AS shown_fps, n * delay_cs / 100.0::DOUBLE AS total_s
        FROM timed"""),
    "g4_first_supported": X.with_tables("jobs", f"""
        WITH {_SUPPORT},
        best AS (SELECT job_id, s.codec, arg_min(struct_pack(o := option, a := accel_rank),
                        accel_rank * 100 + rank) AS hit
                 FROM jobs j, supports s WHERE max_w >= w AND max_h >= h GROUP BY job_id, s.codec)
        SELECT j.job_id, j.codec, j.w, j.h, own.hit.o AS option,
               ['prefer-hardware', 'no-preference'][own.hit.a + 1] AS accel,
               CASE WHEN own.hit IS NOT NULL THEN 'ok'
                    WHEN alt.hit IS NOT NULL THEN 'switch to ' || alt.codec
                    ELSE 'pick a smaller size' END AS advice
        FROM jobs j LEFT JOIN best own ON own.job_id = j.job_id AND own.codec = j.codec
             LEFT JOIN best alt ON alt.job_id = j.job_id AND alt.codec <> j.codec"""),
    "g5_size_report": X.with_tables("jobs", f"""
        WITH {_VARIANTS.strip()}
        SELECT fmt, tier, count(*) AS runs, CAST(sum(n * w * h * 4) AS BIGINT) AS src_bytes,
               CAST(sum(frames * w * h * (quality + 20) // 100) AS BIGINT) AS out_bytes,
               round(sum(n * w * h * 4)::DOUBLE / sum(frames * w * h * (quality + 20) // 100)::DOUBLE, 9) AS ratio
        FROM variants GROUP BY fmt, tier"""),
    "g6_evict_cold": X.with_tables("samples", """
        SELECT doc_id, item_id, last_seen FROM (
            SELECT asset_id AS doc_id, sample_id AS item_id, t_us AS last_seen, vis, total,
                   row_number() OVER (PARTITION BY asset_id, vis ORDER BY t_us, sample_id) AS rn
            FROM (SELECT *, k % 10 = 0 AS vis, count(*) OVER (PARTITION BY asset_id) AS total FROM samples))
        WHERE NOT vis AND total > 24 AND rn <= total - 24"""),
    "g7_restore_settings": X.with_tables("assets", """
        WITH files AS (SELECT asset_id, 'asset' || asset_id AS name,
                              duration_us + CASE WHEN asset_id % 3 = 0 THEN 1 ELSE 0 END AS size,
                              start_us AS mtime FROM assets),
        saved AS (SELECT 'asset' || asset_id AS name, duration_us AS size, start_us AS mtime,
                         asset_id % 30 + 1 AS fps, asset_id % 100 AS quality, in_us, out_us
                  FROM assets WHERE asset_id % 10 <> 0),
        latest AS (SELECT * FROM saved ORDER BY mtime DESC, name DESC LIMIT 1)
        SELECT f.name, f.size, f.mtime, s.name IS NOT NULL AS same_file,
               coalesce(s.fps, l.fps) AS g_fps, coalesce(s.quality, l.quality) AS g_quality,
               s.in_us AS t_start, s.out_us AS t_end
        FROM files f LEFT JOIN saved s USING (name, size, mtime), latest l"""),
}
