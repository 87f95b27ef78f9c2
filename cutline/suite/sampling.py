"""Registered queries of the sampling family with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import intervals as B
from cutline.operators import sampling as C
from cutline.operators import thinning
from cutline.plans.stage import stage

HOUR = 3600 * X.SECOND
POINTS = 45
FRAME_US = 66_667
GRID_RATE = 1 / (36 * 3600)
CLOCK = 1_000_000
TRACK_FPS = 6.0


def _slim(spark, sf):
    return X.samples(spark, sf).select("asset_id", "sample_id", "t_us")


def _keep(spark, sf):
    return stage(B.keep_ranges(X.assets(spark, sf), X.cuts(spark, sf)), "keep")


def _asof(spark, sf):
    grid = stage(C.uniform_grid(_keep(spark, sf), HOUR), "grid")
    return C.asof_sample(grid, _slim(spark, sf), X.assets(spark, sf))


def _tracks(spark, sf):
    """Tracks on a compressed clock, of which about half are faster than the target."""
    timed = C.ticks_to_us(X.media_samples(spark, sf)).selectExpr(
        "asset_id", "sample_id", "track", f"t_us div {CLOCK} as t_us", "dur_us")
    return thinning.thin_tracks(timed, C.estimate_fps(timed), TRACK_FPS).drop("dur_us")


def _variants(spark, sf):
    return X.jobs(spark, sf).select(
        "job_id", "n", (F.lit(100.0) / F.col("fps")).alias("base_delay_cs")
    )


def _c10(spark, sf):
    dur = F.when(F.col("k") % 3 != 0, F.col("k") * 1000)
    timed = X.samples(spark, sf).select("asset_id", "sample_id", "t_us", dur.alias("dur_us"))
    return C.restamp(timed, _keep(spark, sf), FRAME_US)


QUERIES = {
    "c1_uniform_grid": lambda s, d: C.uniform_grid(_keep(s, d), HOUR),
    "c1_grid_count": lambda s, d: C.grid_count(_keep(s, d), HOUR),
    "c2_even_grid": lambda s, d: C.even_grid(_keep(s, d), POINTS),
    "c2_even_grid_at_rate": lambda s, d: C.even_grid_at_rate(_keep(s, d), GRID_RATE),
    "c3_asof_sample": _asof,
    "c4_thin_min_gap": lambda s, d: thinning.thin_min_gap(_slim(s, d), X.GAP_36000S),
    "c4_thin_tracks": _tracks,
    "c5_take_every": lambda s, d: C.take_every(_slim(s, d), 3),
    "c6_mark_keyframes": lambda s, d: C.mark_keyframes(_slim(s, d), 2.5),
    "c7_retime_speed": lambda s, d: C.retime(_variants(s, d), "speed", speed=1.5),
    "c7_retime_duration": lambda s, d: C.retime(_variants(s, d), "duration", duration_s=3.0),
    "c8_ticks_to_us": lambda s, d: C.ticks_to_us(X.media_samples(s, d)),
    "c9_estimate_fps": lambda s, d: C.estimate_fps(C.ticks_to_us(X.media_samples(s, d))),
    "c10_restamp": _c10,
}

_MICROS = """
    SELECT *, CAST(floor(cts / timescale * 1e6 + 0.5) AS BIGINT) AS t_us,
           CAST(floor(dur / timescale * 1e6 + 0.5) AS BIGINT) AS dur_us
    FROM (SELECT asset_id, sample_id, track, timescale, CAST(cts AS DOUBLE) AS c,
                 cts, dur FROM media_samples)"""


def greedy_sql(slack: int) -> str:
    return X.with_tables("samples", f"""
        WITH picks AS (
            SELECT asset_id, min(t_us) AS t_us FROM samples GROUP BY asset_id
            UNION ALL
            SELECT s.asset_id, min(s.t_us) FROM picks p JOIN samples s
              ON s.asset_id = p.asset_id AND s.t_us + {slack} >= p.t_us + {X.GAP_36000S}
            GROUP BY s.asset_id, p.t_us)
        SELECT s.asset_id, min(s.sample_id) AS sample_id, s.t_us
        FROM picks p JOIN samples s ON s.asset_id = p.asset_id AND s.t_us = p.t_us
        GROUP BY s.asset_id, s.t_us""", recursive=True)


def _retime_sql(raw: str) -> str:
    return X.with_tables("jobs", f"""
        SELECT job_id, n, base_delay_cs, delay_cs, 100.0::DOUBLE / delay_cs AS shown_fps,
               n * delay_cs / 100.0::DOUBLE AS total_s
        FROM (SELECT job_id, n, base_delay_cs, greatest(1, CAST(floor(
                  greatest(1.0::DOUBLE, {raw}) + 0.5::DOUBLE) AS BIGINT)) AS delay_cs
              FROM (SELECT job_id, n, 100.0::DOUBLE / fps AS base_delay_cs FROM jobs))""")


ORACLE = {
    "c1_uniform_grid": X.with_tables("keep", f"""
        SELECT asset_id, unnest(range(st_us, en_us - 100, {HOUR})) AS t_us FROM keep"""),
    "c1_grid_count": X.with_tables("keep", f"""
        SELECT asset_id, CAST(sum(len(range(st_us, en_us - 100, {HOUR}))) AS BIGINT) AS n
        FROM keep GROUP BY asset_id"""),
    "c2_even_grid": X.with_tables("kept_acc", f"""
        WITH totals AS (SELECT asset_id, CAST(sum(en_us - st_us) AS BIGINT) AS total
                        FROM keep GROUP BY asset_id),
        pts AS (SELECT asset_id, i, total * (2 * i + 1) // (2 * {POINTS}) AS o_us
                FROM totals, (SELECT unnest(range({POINTS})) AS i))
        SELECT p.asset_id, i, o_us, min(st_us + o_us - acc) AS t_us
        FROM pts p JOIN kept_acc k ON p.asset_id = k.asset_id
         AND o_us <= acc + en_us - st_us AND (o_us > acc OR acc = 0)
        GROUP BY ALL"""),
    "c2_even_grid_at_rate": X.with_tables("kept_acc", f"""
        WITH totals AS (SELECT asset_id, CAST(sum(en_us - st_us) AS BIGINT) AS total
                        FROM keep GROUP BY asset_id),
        sized AS (SELECT *, greatest(2, CAST(floor(total * ({GRID_RATE!r}::DOUBLE / 1e6::DOUBLE) + 0.5) AS BIGINT)) AS n FROM totals),
        pts AS (SELECT asset_id, i, total * (2 * i + 1) // (2 * n) AS o_us
                FROM (SELECT *, unnest(range(n)) AS i FROM sized))
        SELECT p.asset_id, i, o_us, min(st_us + o_us - acc) AS t_us
        FROM pts p JOIN kept_acc k ON p.asset_id = k.asset_id
         AND o_us <= acc + en_us - st_us AND (o_us > acc OR acc = 0)
        GROUP BY ALL"""),
    "c3_asof_sample": X.with_tables("keep assets samples", f"""
        WITH grid AS (SELECT asset_id, unnest(range(st_us, en_us - 100, {HOUR})) AS t_us FROM keep),
        capped AS (SELECT g.asset_id, t_us, least(t_us, end_us - 1000) AS at_us
                   FROM grid g JOIN assets USING (asset_id))
        SELECT c.asset_id, c.t_us, s.sample_id
        FROM capped c ASOF LEFT JOIN samples s
          ON c.asset_id = s.asset_id AND c.at_us >= s.t_us"""),
    "c4_thin_min_gap": greedy_sql(1),
    "c4_thin_tracks": X.with_tables("media_samples", f"""
        WITH timed AS (SELECT asset_id, sample_id, track, t_us // {CLOCK} AS t_us, dur_us FROM ({_MICROS})),
        rates AS (SELECT asset_id, track, count(*) AS n,
                         max(t_us) - min(t_us) + coalesce(
                             arg_max_null(dur_us, struct_pack(t := t_us, s := sample_id)), 0) AS span
                  FROM timed GROUP BY asset_id, track),
        gated AS (SELECT t.*, coalesce({TRACK_FPS}::DOUBLE < CASE WHEN span > 0 THEN n * 1e6::DOUBLE / span END - 0.01::DOUBLE,
                                       false) AS fast
                  FROM timed t JOIN rates USING (asset_id, track)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id, track ORDER BY t_us, sample_id) AS rn
                   FROM gated WHERE fast),
        picks AS (
            SELECT asset_id, track, min(t_us) AS t_us FROM ranked GROUP BY asset_id, track
            UNION ALL
            SELECT s.asset_id, s.track, min(s.t_us) FROM picks p JOIN ranked s
              ON s.asset_id = p.asset_id AND s.track = p.track AND s.t_us + 1 >= p.t_us + {round(1e6 / TRACK_FPS)}
            GROUP BY s.asset_id, s.track, p.t_us)
        SELECT s.asset_id, min(s.sample_id) AS sample_id, s.track, s.t_us
        FROM picks p JOIN ranked s ON s.asset_id = p.asset_id AND s.track = p.track AND s.t_us = p.t_us
        GROUP BY s.asset_id, s.track, s.t_us
        UNION ALL SELECT asset_id, sample_id, track, t_us FROM gated WHERE NOT fast""", recursive=True),
    "c5_take_every": X.with_tables("samples", """
        SELECT asset_id, sample_id, t_us, i FROM (
            SELECT asset_id, sample_id, t_us, row_number() OVER w - 1 AS i,
                   count(*) OVER (PARTITION BY asset_id) AS n
            FROM samples WINDOW w AS (PARTITION BY asset_id ORDER BY t_us, sample_id))
        WHERE i % 3 = 0 AND n > 3"""),
    "c6_mark_keyframes": X.with_tables("samples", """
        SELECT asset_id, sample_id, t_us, i, i % 5 = 0 AS key_frame FROM (
            SELECT asset_id, sample_id, t_us,
                   row_number() OVER (PARTITION BY asset_id ORDER BY t_us, sample_id) - 1 AS i
            FROM samples)"""),
    "c7_retime_speed": _retime_sql("base_delay_cs / 1.5::DOUBLE"),
    "c7_retime_duration": _retime_sql("300.0::DOUBLE / n"),
    "c8_ticks_to_us": X.with_tables(
        "media_samples", f"SELECT * EXCLUDE (c) FROM ({_MICROS})"
    ),
    "c9_estimate_fps": X.with_tables("media_samples", f"""
        SELECT asset_id, track, nb_samples, span_us,
               CASE WHEN span_us > 0 THEN nb_samples * 1e6::DOUBLE / span_us END AS fps
        FROM (SELECT asset_id, track, count(*) AS nb_samples,
                     max(t_us) - min(t_us) + coalesce(
                         arg_max_null(dur_us, struct_pack(t := t_us, s := sample_id)), 0) AS span_us
              FROM ({_MICROS}) GROUP BY asset_id, track)"""),
    "c10_restamp": X.with_tables("samples kept_acc", f"""
        SELECT s.asset_id, sample_id, t_us,
               coalesce(CASE WHEN k % 3 <> 0 THEN k * 1000 END, {FRAME_US}) AS dur_us,
               acc + t_us - st_us AS out_us
        FROM samples s JOIN kept_acc r
          ON s.asset_id = r.asset_id AND t_us >= st_us AND t_us < en_us"""),
}
