"""Geometry of cell tables and boxes: crop, turn, scale, fit, trim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.numeric import clamp, half_up


def crop(cells: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Cells inside the box, with coordinates counted from its corner."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return cells.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def rotate_flip(
    cells: DataFrame, width: int, height: int, rot: int = 0, flip: str = "none"
) -> DataFrame:
    """Flip ("h", "v", "hv"), then turn clockwise by 0, 90, 180 or 270 degrees."""
    x = F.lit(width - 1) - F.col("x") if "h" in flip else F.col("x")
    y = F.lit(height - 1) - F.col("y") if "v" in flip else F.col("y")
    turned = {
        0: (x, y),
        90: (F.lit(height - 1) - y, x),
        180: (F.lit(width - 1) - x, F.lit(height - 1) - y),
        270: (y, F.lit(width - 1) - x),
    }[rot]
    return cells.withColumns({"x": turned[0], "y": turned[1]})


def resample(
    cells: DataFrame, width: int, height: int, to_w: int, to_h: int, col: str = "v"
) -> DataFrame:
    """Area average onto a to_w x to_h grid, up or down.

    Overlaps are counted in whole sub-units (1/to_w of a source cell), so sums are
    exact integers; the partial sums combine before the shuffle.
    """
    def covered(axis: str, size: int, to: int) -> str:
        return (
            f"transform(sequence({axis} * {to} div {size}, (({axis} + 1) * {to} - 1) div {size}),"
            f" t -> struct(t as t, least(({axis} + 1) * {to}, (t + 1) * {size})"
            f" - greatest({axis} * {to}, t * {size}) as n))"
        )

    spread = cells.select(
        "frame_id", col, "y", F.expr(f"explode({covered('x', width, to_w)}) as hx")
    ).select("frame_id", col, "hx", F.expr(f"explode({covered('y', height, to_h)}) as hy"))
    weight = F.col("hx.n") * F.col("hy.n")
    total = F.sum(F.col(col) * weight)
    return (
        spread.groupBy("frame_id", F.col("hx.t").alias("tx"), F.col("hy.t").alias("ty"))
        .agg(total.alias("s"), F.sum(weight).alias("n"))
        .select(
            "frame_id", F.col("tx").cast("int").alias("x"), F.col("ty").cast("int").alias("y"),
            half_up(F.col("s") / F.col("n")).cast("int").alias(col),
        )
    )


# The named aspect ratios.
ASPECTS = {
    "1:1": 1.0, "4:3": 4 / 3, "3:2": 3 / 2, "2:3": 2 / 3, "16:9": 16 / 9, "3:4": 3 / 4,
    "9:16": 9 / 16,
}


def fit_boxes(boxes: DataFrame, aspect: str = "free", rot: int = 0, flip: str = "none") -> DataFrame:
    """boxes(x, y, w, h in a frame fw x fh) carried through turn, flip and aspect.

    A quarter turn also turns the aspect (16:9 becomes 9:16).  The reshaped box keeps its
    centre and is rounded and moved inside the frame.
    """
    if rot in (90, 270) and ":" in aspect:
        aspect = ":".join(reversed(aspect.split(":")))
    x, y, w, h, fw, fh = (F.col(c).cast("double") for c in ("x", "y", "w", "h", "fw", "fh"))
    turned = {
        0: (x, y, w, h, fw, fh),
        90: (fh - (y + h), x, h, w, fh, fw),
        180: (fw - (x + w), fh - (y + h), w, h, fw, fh),
        270: (y, fw - (x + w), h, w, fh, fw),
    }[rot]
    names = ["x", "y", "w", "h", "fw", "fh"]
    out = boxes.withColumns(dict(zip(names, turned)))
    if "h" in flip:
        out = out.withColumn("x", F.col("fw") - (F.col("x") + F.col("w")))
    if "v" in flip:
        out = out.withColumn("y", F.col("fh") - (F.col("y") + F.col("h")))
    if aspect == "orig" or aspect in ASPECTS:
        ratio = F.col("fw") / F.col("fh") if aspect == "orig" else F.lit(ASPECTS[aspect])
        out = out.withColumns(
            {"ar": ratio, "nw": F.col("w"), "nh": F.col("w") / ratio}
        )
        for axis, limit in (("h", "h"), ("w", "fw"), ("h", "fh")):
            if axis == "h":
                over = F.col("nh") > F.col(limit)
                out = out.withColumns(
                    {"nh": F.when(over, F.col(limit)).otherwise(F.col("nh")),
                     "nw": F.when(over, F.col(limit) * F.col("ar")).otherwise(F.col("nw"))}
                )
            else:
                over = F.col("nw") > F.col(limit)
                out = out.withColumns(
                    {"nw": F.when(over, F.col(limit)).otherwise(F.col("nw")),
                     "nh": F.when(over, F.col(limit) / F.col("ar")).otherwise(F.col("nh"))}
                )
        out = out.withColumns(
            {
                "x": F.col("x") + F.col("w") / 2 - F.col("nw") / 2,
                "y": F.col("y") + F.col("h") / 2 - F.col("nh") / 2,
                "w": F.col("nw"), "h": F.col("nh"),
            }
        ).drop("ar", "nw", "nh")
    one = F.lit(1).cast("bigint")
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("fw", "fh")})
    out = out.withColumns(
        {
            "w": F.greatest(one, F.least(half_up(F.col("w")), F.col("fw"))),
            "h": F.greatest(one, F.least(half_up(F.col("h")), F.col("fh"))),
        }
    )
    zero = F.lit(0).cast("bigint")
    return out.withColumns(
        {
            "x": clamp(half_up(F.col("x")), zero, F.col("fw") - F.col("w")),
            "y": clamp(half_up(F.col("y")), zero, F.col("fh") - F.col("h")),
        }
    )


def trim_bbox(cells: DataFrame, width: int, height: int, min_alpha: int = 12) -> DataFrame:
    """Padded bounding box of cells with a > min_alpha; the whole frame when the
    box is no smaller or nothing is visible."""
    seen = F.col("a") > min_alpha
    ends = [(F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1")]
    box = cells.groupBy("frame_id").agg(
        *[fn(F.when(seen, F.col(c))).alias(n) for fn, c, n in ends]
    )
    pad = int(max(width, height) * 0.01 + 0.5)
    smaller = (F.col("x1") - F.col("x0") + 1 < width) | (F.col("y1") - F.col("y0") + 1 < height)
    trimmed = F.coalesce(smaller, F.lit(False))
    padded = {
        "x0": F.greatest(F.lit(0), F.col("x0") - pad),
        "y0": F.greatest(F.lit(0), F.col("y0") - pad),
        "x1": F.least(F.lit(width - 1), F.col("x1") + pad),
        "y1": F.least(F.lit(height - 1), F.col("y1") + pad),
    }
    full = {"x0": 0, "y0": 0, "x1": width - 1, "y1": height - 1}
    return box.withColumn("trimmed", trimmed).select(
        "frame_id",
        *[F.when(F.col("trimmed"), padded[c]).otherwise(full[c]).alias(c) for c in padded],
        "trimmed",
    )
