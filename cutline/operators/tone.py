"""Channels, tone curves, colour maps and alpha on tables of cells.

pixels(frame_id, x, y, r, g, b, a) and cells(frame_id, x, y, v) hold bytes 0-255.
Per-cell work is plain projections, so a chain of these fuses into one stage.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cutline.functions.colormaps import TABULATED
from cutline.functions.numeric import half_up

RGB = ["r", "g", "b"]


def _byte(x: Column) -> Column:
    return half_up(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))).cast("int")


def _lut(table: Sequence[int], v: Column) -> Column:
    """table[v] as a lookup in a literal array."""
    return F.element_at(F.expr(f"array({', '.join(map(str, table))})"), v + 1)


def channel_value(which: str) -> Column:
    """One colour channel, or luma truncated to an integer."""
    if which in RGB:
        return F.col(which)
    luma = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    return luma.cast("int")


def channel(cells: DataFrame, which: str = "luma") -> DataFrame:
    return cells.withColumn("v", channel_value(which))


def curve_luts(curves: DataFrame) -> DataFrame:
    """curves(curve_id, min_x, mid_y, max_x, invert) with `lut` and `is_identity`."""
    out = curves.selectExpr(
        "*",
        "ln(least(0.999D, greatest(0.001D, mid_y / 255D))) / ln(0.5D) as gamma",
    ).selectExpr(
        "*",
        """transform(sequence(0, 255), x -> cast(case
             when max_x <= min_x then if(x < max_x, 0, 255)
             when x <= min_x then 0
             when x >= max_x then 255
             else floor(255 * pow((x - min_x) / cast(max_x - min_x as double), gamma) + 0.5D)
           end as int)) as natural""",
    )
    return out.selectExpr(
        *curves.columns,
        "if(invert, reverse(natural), natural) as lut",
        "not invert and natural = sequence(0, 255) as is_identity",
    )


def apply_curve(cells: DataFrame, table: Sequence[int]) -> DataFrame:
    return cells.withColumns({c: _lut(table, F.col(c)) for c in RGB})


def colormap(
    cells: DataFrame,
    lut: DataFrame,
    key: str,
    reverse: bool = False,
    which: str = "luma",
    curve: Sequence[int] | None = None,
) -> DataFrame:
    """Channel, optional curve, then the map's row; alpha is left alone.

    One map has 256 rows, hence the broadcast.  A key the table does not hold
    falls back to gray, which maps a value to itself; a tabulated map the table
    lacks is an error.
    """
    if key in TABULATED and lut.where(F.col("map_key") == key).isEmpty():
        raise ValueError(f"supply the table of the map {key!r}")
    v = channel_value(which)
    if curve is not None:
        v = _lut(curve, v)
    if reverse:
        v = F.lit(255) - v
    rows = lut.where((F.col("map_key") == key) & F.col("idx").between(0, 255)).select(
        F.col("idx").alias("__v"), *[F.col(c).alias(f"__{c}") for c in RGB]
    ).dropDuplicates(["__v"])
    joined = cells.withColumn("__v", v).join(F.broadcast(rows), "__v", "left")
    return joined.withColumns(
        {c: F.coalesce(f"__{c}", "__v") for c in RGB}
    ).select(*cells.columns)


def level_maps(cells: DataFrame, lut: DataFrame, which: str = "luma") -> DataFrame:
    """(map_key, idx, n, r, g, b): how many cells each level has, and its colour in every map of `lut`.

    A preview of all maps at once: the cells are counted first, so maps meet 256 levels and no cells.
    """
    levels = cells.groupBy(channel_value(which).cast("int").alias("idx")).agg(F.count("*").alias("n"))
    return lut.join(F.broadcast(levels), "idx").select("map_key", "idx", "n", *RGB)


def pixel_effects(
    cells: DataFrame,
    lut: DataFrame,
    which: str = "rgb",
    key: str = "none",
    reverse: bool = False,
    curve: Sequence[int] | None = None,
) -> DataFrame:
    """A single channel is always mapped (gray by default); full colour only curved."""
    active = curve is not None and list(curve) != list(range(256))
    if which != "rgb":
        return colormap(cells, lut, key, reverse, which, curve if active else None)
    return apply_curve(cells, curve) if active else cells


# --- colour matrices ---------------------------------------------------------


def _mix(base: list[list[float]], toward: list[list[float]], k: float) -> list[list[float]]:
    return [[b + k * t for b, t in zip(rb, rt)] for rb, rt in zip(base, toward)]


# Coefficients of the W3C Filter Effects matrices.
_LUM = [0.213, 0.715, 0.072]
_GRAY = [0.2126, 0.7152, 0.0722]
_SEPIA = [[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]]
_HUE_COS = [[0.787, -0.715, -0.072], [-0.213, 0.285, -0.072], [-0.213, -0.715, 0.928]]
_HUE_SIN = [[-0.213, -0.715, 0.928], [0.143, 0.140, -0.283], [-0.787, 0.715, 0.072]]
_EYE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def filter_step(name: str, k: float) -> tuple[list[list[float]], float]:
    """Matrix and offset (in bytes) of one filter step."""
    if name == "grayscale":
        return _mix([[v * k for v in _GRAY]] * 3, _EYE, 1 - k), 0.0
    if name == "sepia":
        return _mix([[v * k for v in row] for row in _SEPIA], _EYE, 1 - k), 0.0
    if name == "saturate":
        return _mix([[v * (1 - k) for v in _LUM]] * 3, _EYE, k), 0.0
    if name == "hue-rotate":
        rad = math.radians(k)
        turned = _mix([_LUM] * 3, _HUE_COS, math.cos(rad))
        return _mix(turned, _HUE_SIN, math.sin(rad)), 0.0
    if name == "brightness":
        return [[v * k for v in row] for row in _EYE], 0.0
    if name == "contrast":
        return [[v * k for v in row] for row in _EYE], 255 * (0.5 - 0.5 * k)
    if name == "invert":
        return [[v * (1 - 2 * k) for v in row] for row in _EYE], 255 * k
    raise ValueError(f"unknown filter step {name!r}")


# The named presets.
PRESETS = {
    "none": [],
    "grayscale": [("grayscale", 1.0)],
    "sepia": [("sepia", 1.0)],
    "invert": [("invert", 1.0)],
    "contrast": [("contrast", 1.5)],
    "warm": [("sepia", 0.35), ("saturate", 1.4), ("hue-rotate", -15.0), ("brightness", 1.05)],
    "cool": [("saturate", 1.2), ("hue-rotate", 25.0), ("brightness", 1.03)],
    "vintage": [
        ("sepia", 0.5), ("contrast", 1.1), ("brightness", 1.1), ("saturate", 1.3),
        ("hue-rotate", -10.0),
    ],
}


def color_matrix(cells: DataFrame, preset: str) -> DataFrame:
    """A preset's steps in turn, each rounded and limited to a byte."""
    out = cells
    for name, k in PRESETS.get(preset, []):
        matrix, offset = filter_step(name, k)
        out = out.withColumns(
            {
                c: _byte(F.col("r") * m[0] + F.col("g") * m[1] + F.col("b") * m[2] + offset)
                for c, m in zip(RGB, matrix)
            }
        )
    return out


# --- histograms ---------------------------------------------------------------


def histogram256(
    cells: DataFrame, table: Sequence[int], width: int, height: int, max_points: int = 40_000
) -> DataFrame:
    """Counts per (frame, bin) of the values and of their curve-mapped versions.

    Large frames are sampled at every `stride`-th position; the position follows
    from x and y, so no ordering is needed.  Both histograms come out of one
    aggregation.
    """
    stride = max(1, width * height // max_points)
    sampled = cells.where((F.col("y") * width + F.col("x")) % stride == 0)
    hits = F.array(
        F.struct(F.col("v").alias("bin"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(_lut(table, F.col("v")).alias("bin"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )
    return (
        sampled.select("frame_id", F.inline(hits))
        .groupBy("frame_id", "bin")
        .agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    )


def normalize_hist(hist: DataFrame, log: bool = False) -> DataFrame:
    """Bar heights: counts, or log1p of them, over the frame's largest."""
    frame = Window.partitionBy("frame_id")  # at most 256 rows each
    out = hist
    for side in ("in", "out"):
        value = F.log1p(F.col(f"n_{side}")) if log else F.col(f"n_{side}").cast("double")
        top = F.max(value).over(frame)
        out = out.withColumn(f"h_{side}", F.when(top > 0, value / top).otherwise(0.0))
    return out


# --- alpha ---------------------------------------------------------------------


def soft_threshold(cells: DataFrame, thr: float) -> DataFrame:
    """Fade out light cells: a ramp of 0.35 below the threshold (percent)."""
    hi = thr / 100
    lo = max(0.0, hi - 0.35)
    light = (F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) / 255
    cover = F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(hi) - light) / F.lit(max(1e-3, hi - lo)))
    )
    return cells.withColumn("a", half_up(F.col("a") * cover).cast("int"))


def parse_hex(text: str | None) -> tuple[int, int, int]:
    """#rrggbb; anything else is near-black."""
    found = re.fullmatch(r"#?([0-9a-fA-F]{6})", text or "")
    return tuple(bytes.fromhex(found[1] if found else "111111"))


def recolor(cells: DataFrame, hex_color: str) -> DataFrame:
    ink = dict(zip(RGB, parse_hex(hex_color)))
    return cells.withColumns(
        {c: F.when(F.col("a") != 0, ink[c]).otherwise(F.col(c)) for c in RGB}
    )


def alpha_flags(cells: DataFrame, by: Sequence[str] = ("frame_id",)) -> DataFrame:
    """has_alpha: some a < 250; not_opaque: the AND of all alphas is not 255."""
    return cells.groupBy(*by).agg(
        F.bool_or(F.col("a") < 250).alias("has_alpha"),
        (F.bit_and("a") != 255).alias("not_opaque"),
    )


def composite_over(bottom: DataFrame, top: DataFrame, opacity: float = 1.0) -> DataFrame:
    """Source-over blend of two pixel tables, truncated to bytes."""
    key = ["frame_id", "x", "y"]
    under = bottom.select(*key, *[F.col(c).alias(f"b{c}") for c in [*RGB, "a"]])
    over = top.select(*key, *[F.col(c).alias(f"t{c}") for c in [*RGB, "a"]])
    both = under.join(over, key, "full_outer").withColumns({
        "top_alpha": F.coalesce("ta", F.lit(0)) * F.lit(1 / 255) * F.lit(opacity),
        "low_alpha": F.coalesce("ba", F.lit(0)) * F.lit(1 / 255),
    })
    keep = F.lit(1.0) - F.col("top_alpha")
    both = both.withColumn("out_alpha", F.col("top_alpha") + F.col("low_alpha") * keep)
    both = both.withColumn(
        "per_alpha", F.when(F.col("out_alpha") == 0, 0.0).otherwise(F.lit(1.0) / F.col("out_alpha")))

    def mixed(c: str) -> Column:
        above = F.coalesce(f"t{c}", F.lit(0)) * F.col("top_alpha")
        below = F.coalesce(f"b{c}", F.lit(0)) * F.col("low_alpha")
        blended = F.floor((above + below * keep) * F.col("per_alpha")).cast("int")
        return F.when(F.col("ta").isNull(), F.col(f"b{c}")).otherwise(blended).alias(c)

    alpha = F.floor(F.lit(255) * F.col("out_alpha")).cast("int")
    return both.select(
        *key, *[mixed(c) for c in RGB],
        F.when(F.col("ta").isNull(), F.col("ba")).otherwise(alpha).alias("a"),
    )


def premultiply(cells: DataFrame, round_alpha: bool = False) -> DataFrame:
    """Colours times alpha, truncated; alpha optionally forced to 0 or 255."""
    alpha = F.when(F.col("a") < 128, 0).otherwise(255) if round_alpha else F.col("a")
    scaled = {c: F.floor(F.col(c) * (alpha * F.lit(1 / 255))).cast("int") for c in RGB}
    return cells.withColumns({**scaled, "a": alpha})


def oval_mask(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Clear cells whose centre lies outside the inscribed ellipse (no smoothing)."""
    dx = (F.col("x") + 0.5 - width / 2) / (width / 2)
    dy = (F.col("y") + 0.5 - height / 2) / (height / 2)
    inside = dx * dx + dy * dy <= 1
    return cells.withColumns({c: F.when(inside, F.col(c)).otherwise(0) for c in [*RGB, "a"]})
