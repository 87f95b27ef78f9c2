"""Lookup tables for byte values: tone curves and colour maps.

Colour maps come as a table lut(map_key, idx, r, g, b).  Maps with a published
closed form or a short list of anchors are generated here; tabulated ones (the
perceptually uniform family) are supplied by the caller in the same shape.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# End points of the ramps, as (r, g, b).
RAMPS = {
    "gray": ((0, 0, 0), (255, 255, 255)),
    "black-red": ((0, 0, 0), (255, 0, 0)),
    "black-green": ((0, 0, 0), (0, 255, 0)),
    "black-blue": ((0, 0, 0), (0, 0, 255)),
    "cool": ((0, 255, 255), (255, 0, 255)),
}

# Evenly spaced anchors of the published ColorBrewer schemes.
BREWER = {
    "Greys": [
        "ffffff", "f0f0f0", "d9d9d9", "bdbdbd", "969696", "737373",
        "525252", "252525", "000000",
    ],
    "Reds": [
        "fff5f0", "fee0d2", "fcbba1", "fc9272", "fb6a4a", "ef3b2c",
        "cb181d", "a50f15", "67000d",
    ],
    "Greens": [
        "f7fcf5", "e5f5e0", "c7e9c0", "a1d99b", "74c476", "41ab5d",
        "238b45", "006d2c", "00441b",
    ],
    "Blues": [
        "f7fbff", "deebf7", "c6dbef", "9ecae1", "6baed6", "4292c6",
        "2171b5", "08519c", "08306b",
    ],
    "Oranges": [
        "fff5eb", "fee6ce", "fdd0a2", "fdae6b", "fd8d3c", "f16913",
        "d94801", "a63603", "7f2704",
    ],
    "Purples": [
        "fcfbfd", "efedf5", "dadaeb", "bcbddc", "9e9ac8", "807dba",
        "6a51a3", "54278f", "3f007d",
    ],
    "RdBu": [
        "67001f", "b2182b", "d6604d", "f4a582", "fddbc7", "f7f7f7",
        "d1e5f0", "92c5de", "4393c3", "2166ac", "053061",
    ],
    "Spectral": [
        "9e0142", "d53e4f", "f46d43", "fdae61", "fee08b", "ffffbf",
        "e6f598", "abdda4", "66c2a5", "3288bd", "5e4fa2",
    ],
}

# Names of maps that exist as tables only.
TABULATED = ("viridis", "plasma", "inferno", "magma", "cividis", "turbo", "coolwarm")

# Break points (position, level) per channel, both in 0..1.
SEGMENTS = {
    "hot": (
        ((0, 0.0416), (0.365079, 1), (1, 1)),
        ((0, 0), (0.365079, 0), (0.746032, 1), (1, 1)),
        ((0, 0), (0.746032, 0), (1, 1)),
    ),
    "bone": (
        ((0, 0), (0.746032, 0.652778), (1, 1)),
        ((0, 0), (0.365079, 0.319444), (0.746032, 0.777778), (1, 1)),
        ((0, 0), (0.365079, 0.444444), (1, 1)),
    ),
    "copper": (
        ((0, 0), (0.809524, 1), (1, 1)),
        ((0, 0), (1, 0.7812)),
        ((0, 0), (1, 0.4975)),
    ),
    "jet": (
        ((0, 0), (0.35, 0), (0.66, 1), (0.89, 1), (1, 0.5)),
        ((0, 0), (0.125, 0), (0.375, 1), (0.64, 1), (0.91, 0), (1, 0)),
        ((0, 0.5), (0.11, 1), (0.34, 1), (0.65, 0), (1, 0)),
    ),
}


def anchors() -> dict[str, list[list[tuple[float, float]]]]:
    """Every generated map as three lists of (position, level), both in 0..1."""
    maps = {}
    for key, ends in RAMPS.items():
        maps[key] = [[(0.0, ends[0][c] / 255), (1.0, ends[1][c] / 255)] for c in range(3)]
    for key, anchors in BREWER.items():
        stops = [bytes.fromhex(h) for h in anchors]
        last = len(stops) - 1
        maps[key] = [[(i / last, s[c] / 255) for i, s in enumerate(stops)] for c in range(3)]
    for key, parts in SEGMENTS.items():
        maps[key] = [[(float(x), float(y)) for x, y in part] for part in parts]
    return maps


def builtin_luts(spark: SparkSession) -> DataFrame:
    """lut(map_key, idx, r, g, b) of the generated maps, 256 rows each."""
    rows = [
        (key, c, a[0], a[1], b[0], b[1])
        for key, channels in anchors().items()
        for c, stops in enumerate(channels)
        for a, b in zip(stops, stops[1:])
    ]
    spans = spark.createDataFrame(rows, "map_key string, c int, x0 double, y0 double, x1 double, y1 double")
    inside = "idx / 255D >= x0 and (idx / 255D < x1 or (x1 = 1 and idx = 255))"
    along = "(idx - x0 * 255D) / (x1 * 255D - x0 * 255D)"
    # the published tables round halves to even
    level = f"cast(rint(({along} * (y1 - y0) + y0) * 255D) as int)"
    points = spans.selectExpr("*", "explode(sequence(0, 255)) as idx").where(inside)
    lines = points.groupBy("map_key", "idx").agg(
        *[F.expr(f"max(case when c = {i} then {level} end) as {n}") for i, n in enumerate("rgb")]
    )
    waves = {"r": "abs(2 * idx / 255D - 0.5D)", "g": "sin(pi() * idx / 255D)", "b": "cos(pi() * idx / 510D)"}
    rainbow = spark.range(256).selectExpr("'rainbow' as map_key", "cast(id as int) as idx").selectExpr(
        "*", *[f"cast(rint(least(1D, greatest(0D, {e})) * 255D) as int) as {c}" for c, e in waves.items()])
    return lines.union(rainbow)


def tone_curve(min_x: int, mid_y: float, max_x: int, invert: bool = False) -> list[int]:
    """256-entry levels-and-gamma table of one curve, for literal use.

    The default curve (0, 128, 255) has gamma 0.994, so it is not the identity.
    """
    gamma = math.log(min(0.999, max(0.001, mid_y / 255))) / math.log(0.5)
    span = max_x - min_x

    def value(x: int) -> int:
        if span <= 0:
            return 0 if x < max_x else 255
        if x <= min_x:
            return 0
        if x >= max_x:
            return 255
        return math.floor(255 * ((x - min_x) / span) ** gamma + 0.5)

    table = [value(x) for x in range(256)]
    return table[::-1] if invert else table
