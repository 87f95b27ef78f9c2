"""Registered queries of the interval family with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import intervals as B
from cutline.plans.stage import stage

SAMPLE = ["asset_id", "sample_id", "t_us"]


def _slim(spark, sf):
    return X.samples(spark, sf).select(*SAMPLE)


def _keep(spark, sf):
    return B.keep_ranges(X.assets(spark, sf), X.cuts(spark, sf))


def kept_samples(spark, sf):
    """Flagship: which samples survive trim and cuts, and at what output time."""
    out = B.kept_samples(_slim(spark, sf), X.assets(spark, sf), X.cuts(spark, sf))
    return out.select(*SAMPLE, "out_us")


def _floored(spark, sf):
    a = X.assets(spark, sf)
    return B.floored_duration(a, B.clip_intervals(a, X.cuts(spark, sf)))


def _b6(spark, sf, empty):
    keep = stage(_keep(spark, sf), "keep")
    at = B.to_output_time(_slim(spark, sf), keep).select(
        "asset_id", "sample_id", F.col("out_us").alias("o_us")
    )
    at = stage(at, "points")
    return B.from_output_time(at, keep, X.assets(spark, sf) if empty == "in" else None)


def _b8_pruned(spark, sf):
    """The trim window over only those events that some window can hold."""
    a = stage(X.assets(spark, sf), "assets")
    near = B.prune_to_assets(X.table(spark, sf, "events"), a, "ts")
    return B.trim_window(X.samples(spark, sf, near).select(*SAMPLE), a)


QUERIES = {
    "b8_trim_pruned": _b8_pruned,
    "b1_clip_intervals": lambda s, d: B.clip_intervals(X.assets(s, d), X.cuts(s, d)),
    "b2_merge_intervals": lambda s, d: B.merge_intervals(X.cuts(s, d)),
    "b3_keep_ranges": _keep,
    "b4_kept_duration": lambda s, d: B.kept_duration(X.assets(s, d), _keep(s, d)),
    "b4_floored_duration": _floored,
    "b5_to_output_time": lambda s, d: B.to_output_time(_slim(s, d), stage(_keep(s, d), "keep")),
    "b5_kept_samples": kept_samples,
    "b6_from_output_time": lambda s, d: _b6(s, d, "in"),
    "b7_drop_cut_samples": lambda s, d: B.drop_cut_samples(_slim(s, d), X.cuts(s, d)),
    "b8_trim_window": lambda s, d: B.trim_window(_slim(s, d), X.assets(s, d)),
    "b9_snap_to_kept": lambda s, d: B.snap_to_kept(_slim(s, d), X.assets(s, d), X.cuts(s, d)),
    "b9_snap_with_slack": lambda s, d: B.snap_to_kept(
        _slim(s, d), X.assets(s, d), X.cuts(s, d), end_slack_us=B.MS
    ),
    "b10_intervals_from_marks": lambda s, d: B.intervals_from_marks(X.marks(s, d)),
    "b11_segment_timeline": lambda s, d: B.segment_timeline(X.assets(s, d), X.cuts(s, d)),
}

_OUT = """
    SELECT s.asset_id, s.sample_id, s.t_us,
           CAST(coalesce(acc + least(s.t_us, en_us) - st_us, 0) AS BIGINT) AS out_us,
           coalesce(s.t_us < en_us, false) AS kept
    FROM samples s ASOF LEFT JOIN kept_acc k ON s.asset_id = k.asset_id AND s.t_us >= k.st_us"""


def _snap(slack: int) -> str:
    return X.with_tables("samples assets cuts", f"""
        SELECT asset_id, sample_id, t_us,
               CASE WHEN t_us >= out_us OR t_us < in_us THEN in_us
                    ELSE coalesce(arg_min(en_us, struct_pack(s := st_us, e := en_us)), t_us) END
                   AS snap_us
        FROM samples JOIN assets USING (asset_id)
             LEFT JOIN (SELECT asset_id AS cid, st_us, en_us FROM cuts)
               ON cid = asset_id AND t_us >= st_us AND t_us < en_us - {slack}
        GROUP BY asset_id, sample_id, t_us, in_us, out_us""")


ORACLE = {
    "b1_clip_intervals": X.with_tables("clipped", "SELECT * FROM clipped"),
    "b2_merge_intervals": X.with_tables("cuts", """
        WITH flagged AS (
            SELECT *, CASE WHEN st_us <= max(en_us) OVER (PARTITION BY asset_id ORDER BY st_us, en_us
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1000 THEN 0 ELSE 1 END AS f
            FROM cuts),
        numbered AS (
            SELECT *, sum(f) OVER (PARTITION BY asset_id ORDER BY st_us, en_us
                                   ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
        SELECT asset_id, min(st_us) AS st_us, max(en_us) AS en_us
        FROM numbered GROUP BY asset_id, island"""),
    "b3_keep_ranges": X.with_tables("keep", "SELECT * FROM keep"),
    "b4_kept_duration": X.with_tables("keep assets", """
        SELECT a.asset_id, CAST(coalesce(sum(k.en_us - k.st_us), 0) AS BIGINT) AS kept_us
        FROM assets a LEFT JOIN keep k USING (asset_id) GROUP BY a.asset_id"""),
    "b4_floored_duration": X.with_tables("clipped assets", """
        SELECT a.asset_id, CAST(greatest(50000, any_value(a.out_us - a.in_us)
                   - coalesce(sum(c.en_us - c.st_us), 0)) AS BIGINT) AS kept_us
        FROM assets a LEFT JOIN clipped c USING (asset_id) GROUP BY a.asset_id"""),
    "b5_to_output_time": X.with_tables("samples kept_acc", _OUT),
    "b5_kept_samples": X.with_tables(
        "samples kept_acc",
        f"SELECT asset_id, sample_id, t_us, out_us FROM ({_OUT}) WHERE kept",
    ),
    "b6_from_output_time": X.with_tables("samples kept_acc assets", f"""
        WITH pts AS (SELECT asset_id, sample_id, out_us AS o_us FROM ({_OUT})),
        hits AS (
            SELECT p.asset_id, p.sample_id, p.o_us, min(k.st_us + p.o_us - k.acc) AS hit
            FROM pts p JOIN kept_acc k ON p.asset_id = k.asset_id
             AND p.o_us <= k.acc + k.en_us - k.st_us AND (p.o_us > k.acc OR k.acc = 0)
            GROUP BY ALL),
        tails AS (SELECT asset_id, max(en_us) AS last_en FROM keep GROUP BY asset_id)
        SELECT p.asset_id, p.sample_id, p.o_us, coalesce(h.hit, last_en, in_us) AS t_us
        FROM pts p JOIN assets USING (asset_id) LEFT JOIN tails USING (asset_id)
             LEFT JOIN hits h ON h.asset_id = p.asset_id AND h.sample_id = p.sample_id"""),
    "b7_drop_cut_samples": X.with_tables("samples cuts", """
        SELECT asset_id, sample_id, t_us FROM samples s WHERE NOT EXISTS (
            SELECT 1 FROM cuts c
            WHERE c.asset_id = s.asset_id AND s.t_us >= c.st_us AND s.t_us < c.en_us)"""),
    "b8_trim_window": X.with_tables("samples assets", """
        SELECT asset_id, sample_id, t_us FROM samples JOIN assets USING (asset_id)
        WHERE t_us + 1 >= in_us AND t_us < out_us"""),
    "b9_snap_to_kept": _snap(0),
    "b9_snap_with_slack": _snap(1000),
    "b10_intervals_from_marks": X.with_tables("marks", """
        WITH runs AS (
            SELECT *, lag(act) OVER w AS prev_act, lag(t_us) OVER w AS prev_t,
                   count(*) FILTER (WHERE act = 'clear') OVER (
                       PARTITION BY asset_id ORDER BY t_us, sample_id
                       ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS clears
            FROM marks WINDOW w AS (PARTITION BY asset_id ORDER BY t_us, sample_id))
        SELECT asset_id, least(prev_t, t_us) AS st_us, greatest(prev_t, t_us) AS en_us,
               clears = 0 AS live
        FROM runs WHERE act = 'commit' AND prev_act = 'arm' AND abs(t_us - prev_t) > 1000"""),
    "b11_segment_timeline": X.with_tables("keep assets cuts", """
        SELECT asset_id, st_us, en_us, 'keep' AS label FROM keep
        UNION ALL SELECT asset_id, start_us, in_us, 'outside' FROM assets WHERE in_us > start_us
        UNION ALL SELECT asset_id, out_us, end_us, 'outside' FROM assets WHERE end_us > out_us
        UNION ALL SELECT asset_id, a, b, 'cut' FROM edges WHERE b > a"""),
}

ORACLE["b8_trim_pruned"] = ORACLE["b8_trim_window"]
