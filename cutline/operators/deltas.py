"""Frame-to-frame changes: change boxes, predecessor choice, delta rows, replay.

Frames are rows (anim_id, seq, x, y, value...).  Comparing a cell with its own past
needs only the cell's history, so the scans run per (anim_id, x, y) and large
animations spread over their cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.plans import scan as S
from cutline.plans.expand import series
from cutline.plans.stage import stage

CELL = ["anim_id", "x", "y"]
FRAME = ["anim_id", "seq"]
RGBA = ["r", "g", "b", "a"]


def _value(cols: Sequence[str]) -> Column:
    return F.struct(*cols)


def with_previous(cells: DataFrame, cols: Sequence[str], depth: int = 1) -> DataFrame:
    """Adds p1 (and p2): the cell's value one (two) frames earlier."""
    scan = S.Scan(cells, CELL, ["seq"]).run(p1=S.previous_row(_value(cols)))
    if depth == 2:
        scan = scan.run(p2=S.previous_row(F.col("p1")))
    return scan.df


def _box(changed: Column, tag: str) -> list[Column]:
    x, y = F.when(changed, F.col("x")), F.when(changed, F.col("y"))
    return [
        F.min(x).alias(f"x0_{tag}"), F.max(x).alias(f"x1_{tag}"),
        F.min(y).alias(f"y0_{tag}"), F.max(y).alias(f"y1_{tag}"),
    ]


def _size(tag: str) -> dict[str, Column]:
    """Box with the no-change case replaced by 1 x 1 at the origin."""
    one, zero = F.lit(1), F.lit(0)
    return {
        f"box_x_{tag}": F.coalesce(f"x0_{tag}", zero),
        f"box_y_{tag}": F.coalesce(f"y0_{tag}", zero),
        f"box_w_{tag}": F.coalesce(F.col(f"x1_{tag}") - F.col(f"x0_{tag}") + 1, one),
        f"box_h_{tag}": F.coalesce(F.col(f"y1_{tag}") - F.col(f"y0_{tag}") + 1, one),
    }


def change_bbox(cells: DataFrame, cols: Sequence[str] = ("q",)) -> DataFrame:
    """Bounding box of the cells that differ from the frame before (seq >= 1)."""
    changed = ~_value(cols).eqNullSafe(F.col("p1"))
    boxes = (
        with_previous(cells, cols).where("seq > 0").groupBy(*FRAME).agg(*_box(changed, "p"))
    )
    s = _size("p")
    return boxes.select(
        *FRAME, s["box_x_p"].alias("box_x"), s["box_y_p"].alias("box_y"),
        s["box_w_p"].alias("box_w"), s["box_h_p"].alias("box_h"),
    )


def best_predecessor(cells: DataFrame, cols: Sequence[str] = ("q",)) -> DataFrame:
    """Compare with one or two frames back, whichever gives the smaller box.

    Ties stay with the previous frame.  Two back is allowed from frame 2 on, and
    not right after a frame that used it (its base would be the restored one), so
    within a run of frames where it would win every other frame takes it.
    `dispose` is 2 where the next frame looks two back.
    """
    return _choose(with_previous(cells, cols, depth=2), _value(cols))


def _choose(past: DataFrame, value: Column) -> DataFrame:
    boxes = (
        past.where("seq > 0")
        .groupBy(*FRAME)
        .agg(*_box(~value.eqNullSafe(F.col("p1")), "p"), *_box(~value.eqNullSafe(F.col("p2")), "q"))
        .withColumns({**_size("p"), **_size("q")})
        .withColumn("area_p", F.col("box_w_p") * F.col("box_h_p"))
        .withColumn("area_q", F.col("box_w_q") * F.col("box_h_q"))
    )
    better = (F.col("seq") >= 2) & (F.col("area_q") < F.col("area_p"))
    sized = stage(boxes.withColumn("better", better), "boxes")
    run = S.Scan(sized, ["anim_id"], ["seq"]).run(
        last_no=S.last_value(F.when(~F.col("better"), F.col("seq"))),
    )
    two = F.col("better") & ((F.col("seq") - F.coalesce("last_no", F.lit(0))) % 2 == 1)
    run = run.map(lambda d: d.withColumn("lag", F.when(two, 2).otherwise(1)))
    run = run.run(next_lag=S.next_value(F.col("lag")))

    def pick(name: str) -> Column:
        return F.when(F.col("lag") == 2, F.col(f"{name}_q")).otherwise(F.col(f"{name}_p"))

    return run.df.select(
        *FRAME, "lag", *[pick(n).alias(n) for n in ("box_x", "box_y", "box_w", "box_h", "area")],
        F.when(F.col("next_lag") == 2, 2).otherwise(0).alias("dispose"),
    )


def delta_encode(pixels: DataFrame) -> DataFrame:
    """Delta rows inside each frame's change box, taken against the predecessor that
    `best_predecessor` chooses; frame 0 is kept whole.

    A frame is blendable unless a changed pixel has new alpha < 220 over old alpha
    > 20.  Blendable frames (blend = 1) blank unchanged pixels, others copy the box.
    `dispose` is 2 where the next frame builds on the one before this one.
    """
    past = stage(with_previous(pixels, RGBA, depth=2), "past")
    choice = stage(_choose(past, _value(RGBA)).drop("area"), "choice")
    base = F.when(F.col("lag") == 2, F.col("p2")).otherwise(F.col("p1"))
    rows = past.join(choice, FRAME, "left").withColumn("base", base)
    changed = ~_value(RGBA).eqNullSafe(F.col("base"))
    blocks = changed & (F.col("a") < 220) & (F.col("base.a") > 20)
    copied = rows.where("seq > 0").groupBy(*FRAME).agg(F.bool_or(blocks).alias("copied"))
    inside = (
        (F.col("x") >= F.col("box_x")) & (F.col("x") < F.col("box_x") + F.col("box_w"))
        & (F.col("y") >= F.col("box_y")) & (F.col("y") < F.col("box_y") + F.col("box_h"))
    )
    blank = ~F.coalesce("copied", F.lit(True)) & ~changed
    return (
        rows.where((F.col("seq") == 0) | inside)
        .join(copied, FRAME, "left")
        .select(
            *FRAME, "x", "y",
            *[F.when(blank, 0).otherwise(F.col(c)).alias(c) for c in RGBA],
            F.when(F.coalesce("copied", F.lit(True)), 0).otherwise(1).alias("blend"),
            F.coalesce("dispose", F.lit(0)).alias("dispose"),
        )
    )


def changed_cells(cells: DataFrame, cols: Sequence[str] = ("q",)) -> DataFrame:
    """Sparse deltas: frame 0 whole, later only the cells that changed."""
    changed = (F.col("seq") == 0) | ~_value(cols).eqNullSafe(F.col("p1"))
    return with_previous(cells, cols).where(changed).select(*FRAME, "x", "y", *cols)


def replay_kept(
    deltas: DataFrame, frames: DataFrame, cols: Sequence[str] = ("q",)
) -> DataFrame:
    """Full frames from replace-and-keep deltas.

    A delta holds until the cell's next one, or to the animation's last frame
    (`frames(anim_id, last_seq)`), so each row expands to its own frames and no
    frame-by-cell grid is joined.
    """
    held = S.Scan(deltas, CELL, ["seq"]).run(until=S.next_value(F.col("seq"))).df
    stop = F.coalesce(F.col("until") - 1, F.col("last_seq"))
    return (
        series(held.join(frames, ["anim_id"]), stop - F.col("seq") + 1, "step")
        .withColumn("seq", F.col("seq") + F.col("step"))
        .select(*FRAME, "x", "y", *cols)
    )


def _over(top: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Source-over of rows of RGBA pixels, truncated to bytes."""
    fa, ba = top[:, 3:] * (1 / 255), under[:, 3:] * (1 / 255)
    keep = 1 - fa
    oa = fa + ba * keep
    part = np.where(oa == 0, 0, 1 / np.where(oa == 0, 1, oa))
    mixed = (top[:, :3] * fa + under[:, :3] * ba * keep) * part
    return np.trunc(np.concatenate([mixed, 255 * oa], axis=1))


def _fold(fresh: np.ndarray, rows: dict[str, np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pixels shown, on the next frame, and on those after it; last state) of draws in order.

    `fresh` flags the first draw of a segment; rows before the first of them go on from `state`,
    the canvas and what a restore brings back.  All segments are stepped together.
    """
    n = len(fresh)
    segment = np.cumsum(fresh)  # 0 goes on from `state`
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    place = np.arange(n) - start
    held = np.zeros((2, int(segment[-1]) + 1, 4))
    held[:, 0] = state
    out = np.zeros((3, n, 4))
    order = np.argsort(place, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        canvas, anchor = held[:, segment[at]]
        drawn, mode = rows["px"][at], rows["dispose"][at][:, None]
        shown = np.where(rows["over"][at][:, None], _over(drawn, canvas), drawn)
        anchor = np.where(mode == 2, anchor, shown)
        canvas = np.where(mode == 2, anchor, np.where(mode == 1, 0, shown))
        # frames that do not touch the pixel: the first restores or confirms, the rest change nothing
        rest = np.where(rows["next"][at][:, None] == 2, anchor, canvas)
        alone = rows["gap"][at][:, None] > 0
        out[:, at] = shown, canvas, rest
        held[:, segment[at]] = np.where(alone, rest, canvas), np.where(alone, rest, anchor)
    return out.astype(np.int32), held[:, -1]


def _replay_fn(keys: list[str], schema: pa.Schema):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, np.zeros((2, 4))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            ident = np.stack([column[k].astype(np.int64) for k in keys])
            fresh = np.ones(n, bool)
            fresh[1:] = (ident[:, 1:] != ident[:, :-1]).any(axis=0)
            fresh[0] = last is None or (ident[:, 0] != last).any()
            last = ident[:, -1]
            rows = {c: column[c] for c in ("over", "dispose", "next", "gap")}
            rows["px"] = np.stack([column[c] for c in RGBA], axis=1).astype(np.float64)
            out, state = _fold(fresh, rows, state)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*CELL, "idx", "gap")), *(pa.array(out[k, :, c]) for k in range(3) for c in range(4))],
                schema=schema)

    return fn


def replay_disposed(
    deltas: DataFrame, frames: DataFrame, width: int, height: int
) -> DataFrame:
    """Full frames under any blend (0 replace, 1 over) and disposal (0 keep, 1 clear
    the box, 2 restore the frame before).

    deltas(anim_id, seq, x, y, r, g, b, a) and frames(anim_id, seq, box_x, box_y,
    box_w, box_h, blend, dispose).  Only draws, the pixels inside a frame's box, are
    folded; the frames up to a pixel's next draw are expanded from what the fold leaves.
    A draw that replaces (or is opaque) and is not restored needs nothing of the past,
    so a pixel's draws are cut there into segments, and segments are folded in parallel: the
    longest fold is a run of translucent or restored draws of one pixel.
    """
    order = S.Scan(frames, ["anim_id"], ["seq"]).run(
        idx=S.row_index(), next=S.next_value(F.col("dispose"))).df
    order = stage(order, "frames")
    total = order.groupBy("anim_id").agg(F.count("*").alias("frames"))

    def span(low: str, size: str, limit: int) -> Column:
        first, last = F.greatest(F.col(low), F.lit(0)), F.least(F.col(low) + F.col(size), F.lit(limit)) - 1
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    boxes = order.withColumn("y", span("box_y", "box_h", height)).withColumn("x", span("box_x", "box_w", width))
    drawn = boxes.join(deltas.select(*FRAME, "x", "y", *RGBA), [*FRAME, "x", "y"], "left").select(
        *CELL, "idx", "dispose", F.coalesce("next", F.lit(0)).alias("next"),
        ((F.col("blend") == 1) & (F.col("seq") > 0)).alias("over"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in RGBA],
    )
    # the empty canvas before the first frame
    before = order.where("idx = 0").select(
        "anim_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), F.col("dispose").alias("next"))
    before = before.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).select(
        *CELL, F.lit(-1).cast("long").alias("idx"), F.lit(0).alias("dispose"), "next", F.lit(False).alias("over"),
        *[F.lit(0).alias(c) for c in RGBA])
    alone = (~F.col("over") | (F.col("a") == 255)) & (F.col("dispose") != 2)
    cut = S.Scan(drawn.unionByName(before), CELL, ["idx"]).run(
        part=S.running_sum(alone.cast("long"), inclusive=True), until=S.next_value(F.col("idx"))).df
    parts = [*CELL, "part"]
    ready = cut.join(total, "anim_id").select(
        *parts, "idx", (F.coalesce("until", "frames") - F.col("idx") - 1).alias("gap"), "dispose", "next", "over", *RGBA)
    seen = [f"{c}{k}" for k in range(3) for c in RGBA]
    kinds = {"anim_id": pa.int64(), "idx": pa.int64(), "gap": pa.int64()}
    schema = pa.schema([pa.field(n, kinds.get(n, pa.int32())) for n in (*CELL, "idx", "gap", *seen)])
    folded = (
        ready.withColumns({c: F.col(c).cast(t) for c, t in
                           (("anim_id", "long"), ("x", "int"), ("y", "int"), ("idx", "long"), ("gap", "long"))})
        .repartition(*parts).sortWithinPartitions(*parts, "idx")
        .mapInArrow(_replay_fn(parts, schema), "anim_id long, x int, y int, idx long, gap long, "
                    + ", ".join(f"{c} int" for c in seen))
    )
    step = F.col("step")
    shown = series(folded, F.col("gap") + 1, "step").where((F.col("idx") >= 0) | (step > 0)).select(
        *CELL, (F.col("idx") + step).alias("idx"),
        *[F.when(step == 0, F.col(f"{c}0")).when(step == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in RGBA])
    return shown.join(order.select("anim_id", "idx", "seq"), ["anim_id", "idx"]).select(
        "anim_id", F.col("seq").cast("long").alias("seq"), "x", "y", *RGBA)
