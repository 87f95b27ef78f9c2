"""Event-rate control over finished tables; `cutline.streaming` has the live forms.

events(asset_id, sample_id, t_us, ...) in order of (t_us, sample_id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.operators import intervals as B
from cutline.operators.thinning import thin_min_gap
from cutline.plans import scan as S
from cutline.plans.stage import stage
from cutline.plans.topn import first_n

ORDER = ["t_us", "sample_id"]


def debounce(events: DataFrame, gap_us: int, key: Sequence[str] = ("asset_id",)) -> DataFrame:
    """The last event of every burst, with the time its key had been quiet for `gap`.

    An event survives when the next one is more than `gap` away; exactly `gap`
    still belongs to the burst.
    """
    rows = S.Scan(events, key, ORDER).run(next_us=S.next_value(F.col("t_us"))).df
    quiet = F.col("next_us").isNull() | (F.col("next_us") - F.col("t_us") > gap_us)
    return rows.where(quiet).withColumn("emit_us", F.col("t_us") + gap_us).drop("next_us")


def coalesce_edits(
    events: DataFrame, gap_us: int, actor: Sequence[str] = ("asset_id",), edit: str = "edit_key"
) -> DataFrame:
    """Adds new_step: the edit has no key, another key than the edit just before, or
    comes more than `gap` after it.  The anchor moves with every edit."""
    rows = S.Scan(events, actor, ORDER).run(
        before=S.previous_row(F.struct(F.col(edit).alias("k"), F.col("t_us").alias("t")))
    ).df
    same = F.col(edit).eqNullSafe(F.col("before.k")) & (F.col("t_us") - F.col("before.t") <= gap_us)
    fresh = F.col("before").isNull() | F.col(edit).isNull() | ~same
    return rows.withColumn("new_step", fresh).drop("before")


def latest_pending(
    requests: DataFrame, completions: DataFrame, key: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """Requests that get issued when only one may be in flight per key.

    While one is, the latest waiting request replaces earlier ones and is issued at
    the completion.  Completions cut a key's time into spans.  A span without
    requests leaves the key idle, one with two or more leaves a request in flight,
    and one with a single request keeps the state as it was.
    """
    key = list(key)
    rows = requests.select(*key, *ORDER, F.lit(0).alias("done")).unionByName(
        completions.select(*key, *ORDER, F.lit(1).alias("done"))
    )
    spans = S.Scan(rows, key, ORDER).run(span=S.running_sum(F.col("done").cast("bigint"))).df
    at = F.struct(*ORDER)
    asked = F.when(F.col("done") == 0, at)
    per_span = stage(
        spans.groupBy(*key, "span").agg(
            F.count_if(F.col("done") == 0).alias("n"), F.min(asked).alias("first"),
            F.max(asked).alias("last"),
            F.max(F.when(F.col("done") == 1, F.col("t_us"))).alias("end_us"),
        ),
        "spans",
    )
    leaves = F.when(F.col("n") == 0, F.lit(False)).when(F.col("n") >= 2, F.lit(True))
    held = S.Scan(per_span, key, ["span"]).run(
        busy=S.last_value(leaves, inclusive=False)
    ).df.withColumn("busy", F.coalesce("busy", F.lit(False)))
    at_once = F.when(~F.col("busy") & (F.col("n") >= 1), F.struct(
        F.col("first.sample_id").alias("sample_id"), F.col("first.t_us").alias("t_us"),
        F.col("first.t_us").alias("issued_us"),
    ))
    waited = (F.col("busy") & (F.col("n") >= 1)) | (F.col("n") >= 2)
    later = F.when(waited & F.col("end_us").isNotNull(), F.struct(
        F.col("last.sample_id").alias("sample_id"), F.col("last.t_us").alias("t_us"),
        F.col("end_us").alias("issued_us"),
    ))
    return held.select(*key, F.explode(F.array_compact(F.array(at_once, later))).alias("r")).select(
        *key, "r.*"
    )


def drop_superseded(
    results: DataFrame, key: Sequence[str], token: str = "token"
) -> DataFrame:
    """Only the result with the highest token per key."""
    rest = [c for c in results.columns if c not in key]
    return results.groupBy(*key).agg(
        F.max_by(F.struct(*rest), token).alias("r")
    ).select(*key, "r.*")


def keep_last_n(
    events: DataFrame, n: int = 60, key: Sequence[str] = ("asset_id",)
) -> DataFrame:
    """The newest n events per key, with their age 1..n."""
    return first_n(events, key, [F.desc(c) for c in ORDER], n, "age")


def kept_thinned(
    samples: DataFrame, assets: DataFrame, keep: DataFrame, interval_us: int, slack_us: int = 1
) -> DataFrame:
    """Trim, drop cut samples, thin, restamp.

    One scan over samples and kept ranges yields both the cut test and the output
    time.  A sample up to `slack` before `in` counts as kept; its output time is
    that little below zero.
    """
    bounds = assets.select("asset_id", "in_us", "out_us")
    t = F.col("t_us")
    trimmed = samples.join(bounds, ["asset_id"]).where(
        (t + slack_us >= F.col("in_us")) & (t < F.col("out_us"))
    ).drop("out_us")
    placed = B.to_output_time(trimmed, keep)
    early = t < F.col("in_us")
    placed = placed.where(F.col("kept") | early).withColumn(
        "out_us", F.when(early, t - F.col("in_us")).otherwise(F.col("out_us"))
    )
    slim = placed.select(*samples.columns, "out_us")
    return thin_min_gap(stage(slim, "placed"), interval_us, slack_us)
