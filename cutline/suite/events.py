"""Registered queries of the event family with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import events as J
from cutline.operators import intervals as B
from cutline.operators import thinning
from cutline.plans.stage import stage, stage_root
from cutline.streaming import live
from cutline.suite.sampling import greedy_sql

SLIM = ["asset_id", "sample_id", "t_us"]


def _slim(s, d):
    return X.samples(s, d).select(*SLIM)


def _edits(s, d):
    """Edits of one actor; an event type stands for the edit key, signups have none."""
    key = F.when(F.col("event_type") != "signup", F.col("event_type"))
    return X.samples(s, d).select(*SLIM, key.alias("edit_key"))


def _pending(s, d):
    rows = X.samples(s, d)
    asks = rows.where(F.col("event_type").isin("click", "view")).select(*SLIM)
    done = rows.where("event_type = 'purchase'").select(*SLIM)
    return J.latest_pending(asks, done)


def _results(s, d):
    return X.samples(s, d).select(
        "asset_id", "event_type", F.col("sample_id").alias("token"), "t_us", "value"
    )


def _kept(s, d):
    a = X.assets(s, d)
    keep = stage(B.keep_ranges(a, B.clip_intervals(a, X.cuts(s, d))), "keep")
    return J.kept_thinned(_slim(s, d), a, keep, X.GAP_36000S)


def _live_kept(s, d):
    """The streaming form over the same events, run to the end with what is then still held."""
    a = X.assets(s, d)
    keep = stage(B.keep_ranges(a, B.clip_intervals(a, X.cuts(s, d))), "keep")
    out = live.stream_kept_samples(live.sample_stream(s, d), a, keep, X.GAP_36000S, buckets=live.BUCKETS)
    return live.thin_to_end(out, "kept", X.GAP_36000S).select(*SLIM, "out_us")


def _stream(s, d):
    """The events as a stream, with the columns the live forms need."""
    rows = live.sample_stream(s, d)
    key = F.when(F.col("event_type") != "signup", F.col("event_type"))
    return rows.withColumns({"edit_key": key, "done": F.col("event_type") == "purchase"})


def _live_coalesce(s, d):
    return live.run_to_table(live.stream_coalesce(
        _stream(s, d).select(*SLIM, "edit_key", "ts"), X.GAP_6H, buckets=live.BUCKETS), "coalesce")


def _live_throttle(s, d):
    rows = live.stream_thin(_stream(s, d).select(*SLIM, "ts"), X.GAP_36000S, 0, buckets=live.BUCKETS)
    return live.run_to_table(rows, "throttle").select(*SLIM)


def _live_pending(s, d):
    asked = F.col("event_type").isin("click", "view", "purchase")
    return live.run_to_table(
        live.stream_latest_pending(_stream(s, d).where(asked).select(*SLIM, "done", "ts"), buckets=live.BUCKETS), "pending")


def _live_debounce(s, d):
    """Bursts that the final watermark has passed."""
    return live.run_to_table(live.stream_debounce(_stream(s, d), "6 hours", "1 hour"), "debounce")


def _live_superseded(s, d):
    """The best result per key in a merge table, after two runs of one stream over growing files."""
    base = f"{stage_root(s)}/superseded-{uuid.uuid4().hex}"
    rows = _results(s, d)
    table = live.MergeTable(s, f"{base}/table", ["asset_id", "event_type"], "token", buckets=8)
    for late in (False, True):
        part = rows.where(F.pmod(F.xxhash64("token"), F.lit(4)).isin([0, 2] if late else [1, 3]))
        part.repartition(2).write.mode("append").parquet(f"{base}/arrived")
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/arrived")
        live.superseded_to_table(stream, table, f"{base}/state").awaitTermination()
    return table.read(rows.select("asset_id", "event_type", "token", "t_us", "value").schema)


QUERIES = {
    "j5_stream_superseded": _live_superseded,
    "j1_stream_debounce": _live_debounce,
    "j2_stream_coalesce": _live_coalesce,
    "j3_stream_throttle": _live_throttle,
    "j4_stream_pending": _live_pending,
    "j1_debounce": lambda s, d: J.debounce(_slim(s, d), X.GAP_6H),
    "j2_coalesce_edits": lambda s, d: J.coalesce_edits(_edits(s, d), X.GAP_6H),
    "j3_throttle": lambda s, d: thinning.throttle(_slim(s, d), X.GAP_36000S),
    "j4_latest_pending": _pending,
    "j5_drop_superseded": lambda s, d: J.drop_superseded(_results(s, d), ["asset_id", "event_type"]),
    "j6_kept_samples": _kept,
    "j6_stream_kept_samples": _live_kept,
    "j7_keep_last_n": lambda s, d: J.keep_last_n(_slim(s, d), 60),
}

_J6 = X.with_tables("samples assets clipped", f"""
    WITH RECURSIVE_PLACEHOLDER placed AS (
        SELECT s.asset_id, sample_id, t_us,
               t_us - in_us - CAST(coalesce((
                   SELECT sum(least(t_us, c.e) - c.s) FROM merged c
                   WHERE c.asset_id = s.asset_id AND c.s < t_us), 0) AS BIGINT) AS out_us
        FROM samples s JOIN assets a USING (asset_id)
        WHERE t_us + 1 >= in_us AND t_us < out_us AND NOT EXISTS (
            SELECT 1 FROM clipped c WHERE c.asset_id = s.asset_id AND t_us >= c.st_us AND t_us < c.en_us)),
    picks AS (
        SELECT asset_id, min(t_us) AS t_us FROM placed GROUP BY asset_id
        UNION ALL
        SELECT s.asset_id, min(s.t_us) FROM picks p JOIN placed s
          ON s.asset_id = p.asset_id AND s.t_us + 1 >= p.t_us + {X.GAP_36000S}
        GROUP BY s.asset_id, p.t_us)
    SELECT asset_id, sample_id, t_us, out_us FROM placed JOIN picks USING (asset_id, t_us)""", recursive=True)
_MERGED = """merged AS (
        SELECT asset_id, min(st_us) AS s, max(en_us) AS e FROM (
            SELECT *, sum(f) OVER (PARTITION BY asset_id ORDER BY st_us, en_us ROWS UNBOUNDED PRECEDING) AS g
            FROM (SELECT *, CASE WHEN st_us <= max(en_us) OVER (PARTITION BY asset_id ORDER BY st_us, en_us
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM clipped))
        GROUP BY asset_id, g),
    """
_J6 = _J6.replace("RECURSIVE_PLACEHOLDER ", _MERGED)

ORACLE = {
    "j1_debounce": X.with_tables("samples", f"""
        SELECT asset_id, sample_id, t_us, t_us + {X.GAP_6H} AS emit_us FROM (
            SELECT asset_id, sample_id, t_us,
                   lead(t_us) OVER (PARTITION BY asset_id ORDER BY t_us, sample_id) AS nx FROM samples)
        WHERE nx IS NULL OR nx - t_us > {X.GAP_6H}"""),
    "j2_coalesce_edits": X.with_tables("samples", f"""
        SELECT asset_id, sample_id, t_us, edit_key,
               pt IS NULL OR edit_key IS NULL OR pk IS DISTINCT FROM edit_key
               OR t_us - pt > {X.GAP_6H} AS new_step
        FROM (SELECT *, lag(edit_key) OVER w AS pk, lag(t_us) OVER w AS pt
              FROM (SELECT asset_id, sample_id, t_us,
                           CASE WHEN event_type <> 'signup' THEN event_type END AS edit_key FROM samples)
              WINDOW w AS (PARTITION BY asset_id ORDER BY t_us, sample_id))"""),
    "j3_throttle": greedy_sql(0),
    "j4_latest_pending": X.with_tables("samples", """
        WITH ev AS (
            SELECT asset_id, sample_id, t_us, event_type = 'purchase' AS done,
                   row_number() OVER (PARTITION BY asset_id ORDER BY t_us, sample_id) AS rn
            FROM samples WHERE event_type IN ('click', 'view', 'purchase')),
        run AS (
            SELECT asset_id, CAST(0 AS BIGINT) AS rn, false AS busy, CAST(NULL AS BIGINT) AS wait_id,
                   CAST(NULL AS BIGINT) AS wait_t, CAST(NULL AS BIGINT) AS out_id,
                   CAST(NULL AS BIGINT) AS out_t, CAST(NULL AS BIGINT) AS issued_us
            FROM ev GROUP BY asset_id
            UNION ALL
            SELECT e.asset_id, e.rn,
                   CASE WHEN NOT e.done THEN true ELSE r.wait_id IS NOT NULL END,
                   CASE WHEN NOT e.done AND r.busy THEN e.sample_id END,
                   CASE WHEN NOT e.done AND r.busy THEN e.t_us END,
                   CASE WHEN NOT e.done AND NOT r.busy THEN e.sample_id WHEN e.done THEN r.wait_id END,
                   CASE WHEN NOT e.done AND NOT r.busy THEN e.t_us WHEN e.done THEN r.wait_t END,
                   CASE WHEN (NOT e.done AND NOT r.busy) OR (e.done AND r.wait_id IS NOT NULL) THEN e.t_us END
            FROM run r JOIN ev e ON e.asset_id = r.asset_id AND e.rn = r.rn + 1)
        SELECT asset_id, out_id AS sample_id, out_t AS t_us, issued_us FROM run WHERE out_id IS NOT NULL""",
        recursive=True),
    "j5_drop_superseded": """
        SELECT user_id AS asset_id, event_type, event_id AS token, epoch_us(ts) AS t_us, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "j6_kept_samples": _J6,
    "j7_keep_last_n": X.with_tables("samples", """
        SELECT asset_id, sample_id, t_us, CAST(age AS INTEGER) AS age FROM (
            SELECT asset_id, sample_id, t_us,
                   row_number() OVER (PARTITION BY asset_id ORDER BY t_us DESC, sample_id DESC) AS age FROM samples)
        WHERE age <= 60"""),
}



def _passed(sql: str, column: str, rows: str = "events") -> str:
    """Rows of `sql` that the last watermark, an hour before the newest of `rows`, has passed."""
    return f"""
        SELECT * FROM ({sql}) WHERE {column} < 1000 * (SELECT max(epoch_ms(ts)) - 3600000 FROM {rows})"""


ORACLE |= {
    "j1_stream_debounce": f"""
        SELECT asset_id, sample_id, t_us, emit_us FROM ({ORACLE['j1_debounce']})
        WHERE emit_us <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""",
    "j2_stream_coalesce": _passed(ORACLE["j2_coalesce_edits"], "t_us"),
    "j3_stream_throttle": _passed(ORACLE["j3_throttle"], "t_us"),
    "j4_stream_pending": _passed(
        ORACLE["j4_latest_pending"], "issued_us", "events WHERE event_type IN ('click', 'view', 'purchase')"),
    "j5_stream_superseded": ORACLE["j5_drop_superseded"],
    "j6_stream_kept_samples": _J6,
}
