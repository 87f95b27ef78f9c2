"""Registered queries of the tone and raster families with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.functions import colormaps
from cutline.operators import raster as E
from cutline.operators import tone as D

PIX = ["frame_id", "x", "y", "r", "g", "b", "a"]
CURVE = colormaps.tone_curve(0, 128, 255)
STRONG = colormaps.tone_curve(64, 90, 192, invert=True)


def _pix(s, d):
    return X.pixels(s, d).select(*PIX)


def _cells(s, d):
    return X.cells(s, d).select("frame_id", "x", "y", "v")


def _curve_rows(s, d):
    out = D.curve_luts(X.curves(s, d))
    return out.select(
        "curve_id", "is_identity", F.posexplode("lut").alias("idx", "y")
    )


def _hist(s, d, points=40_000):
    return D.histogram256(X.cells(s, d), CURVE, 8, 8, points)


def _heights(s, d, log):
    out = D.normalize_hist(_hist(s, d), log)
    return out.withColumns({c: F.round(c, 9) for c in ("h_in", "h_out")})


def _boxes(s, d):
    return X.jobs(s, d).selectExpr(
        "job_id", "job_id % 50 as x", "job_id % 40 as y", "w div 2 as w", "h div 2 as h",
        "w as fw", "h as fh",
    )


def _shifted(s, d):
    return _pix(s, d).withColumn("frame_id", F.col("frame_id") + 1)


QUERIES = {
    "d1_channel": lambda s, d: D.channel(_pix(s, d)),
    "d2_curve_lut": _curve_rows,
    "d3_apply_curve": lambda s, d: D.apply_curve(_pix(s, d), STRONG),
    "d4_colormap": lambda s, d: D.colormap(
        _pix(s, d), colormaps.builtin_luts(s), "black-red", reverse=True, curve=STRONG
    ),
    "d4_all_maps": lambda s, d: D.level_maps(_pix(s, d), colormaps.builtin_luts(s)),
    "d4_colormap_fallback": lambda s, d: D.colormap(
        _pix(s, d), colormaps.builtin_luts(s), "no-such-map", which="g"
    ),
    "d5_pixel_effects": lambda s, d: D.pixel_effects(
        _pix(s, d), colormaps.builtin_luts(s), which="luma", curve=CURVE
    ),
    "d6_color_matrix": lambda s, d: D.color_matrix(_pix(s, d), "sepia"),
    "d6_filter_chain": lambda s, d: D.color_matrix(_pix(s, d), "warm"),
    "d7_histogram256": _hist,
    "d7_histogram_sampled": lambda s, d: _hist(s, d, 16),
    "d8_normalize_hist": lambda s, d: _heights(s, d, False),
    "d8_normalize_hist_log": lambda s, d: _heights(s, d, True),
    "d9_soft_threshold": lambda s, d: D.soft_threshold(_pix(s, d), 62),
    "d10_recolor": lambda s, d: D.recolor(
        _pix(s, d).withColumn("a", F.when(F.col("a") < 110, 0).otherwise(F.col("a"))), "#1d6fd6"
    ),
    "d11_alpha_flags": lambda s, d: D.alpha_flags(_pix(s, d)),
    "d12_composite_over": lambda s, d: D.composite_over(_pix(s, d), _shifted(s, d), 0.6),
    "d13_premultiply": lambda s, d: D.premultiply(_pix(s, d)),
    "d13_premultiply_rounded": lambda s, d: D.premultiply(_pix(s, d), round_alpha=True),
    "d14_oval_mask": lambda s, d: D.oval_mask(_pix(s, d), 4, 4),
    "e1_crop": lambda s, d: E.crop(_cells(s, d), 2, 1, 5, 4),
    "e2_rotate_flip": lambda s, d: E.rotate_flip(_cells(s, d), 8, 8, 90, "h"),
    "e2_rotate_270": lambda s, d: E.rotate_flip(_cells(s, d), 8, 8, 270, "v"),
    "e3_resample": lambda s, d: E.resample(_cells(s, d), 8, 8, 3, 5),
    "e4_fit_boxes": lambda s, d: E.fit_boxes(_boxes(s, d), "16:9", 90, "h"),
    "e4_fit_boxes_orig": lambda s, d: E.fit_boxes(_boxes(s, d), "orig", 180, "v"),
    "e5_trim_bbox": lambda s, d: E.trim_bbox(_pix(s, d), 4, 4, 140),
}

_LUMA = "CAST(floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS INTEGER)"
_COLS = "frame_id, x, y, r, g, b, a"


def _values(table) -> str:
    return "[" + ", ".join(map(str, table)) + "]"


def _byte(e: str) -> str:
    return f"CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {e})) + 0.5::DOUBLE) AS INTEGER)"


def _matrix(source: str, name: str, k: float) -> str:
    m, off = D.filter_step(name, k)
    cols = ", ".join(
        _byte(f"r * ({row[0]!r})::DOUBLE + g * ({row[1]!r})::DOUBLE + b * ({row[2]!r})::DOUBLE"
              f" + ({off!r})::DOUBLE") + f" AS {c}"
        for c, row in zip("rgb", m)
    )
    return f"SELECT frame_id, x, y, {cols}, a FROM ({source})"


def _chain(preset: str) -> str:
    sql = f"SELECT {_COLS} FROM pixels"
    for name, k in D.PRESETS[preset]:
        sql = _matrix(sql, name, k)
    return X.with_tables("pixels", sql)


def _hist_sql(stride: int) -> str:
    return f"""
        SELECT frame_id, bin, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (
            SELECT frame_id, v AS bin, 1 AS i, 0 AS o FROM cells WHERE (y * 8 + x) % {stride} = 0
            UNION ALL
            SELECT frame_id, {_values(CURVE)}[v + 1], 0, 1 FROM cells
            WHERE (y * 8 + x) % {stride} = 0)
        GROUP BY frame_id, bin"""


def _heights_sql(f: str) -> str:
    return X.with_tables("cells", f"""
        SELECT frame_id, bin, n_in, n_out,
               round({f.format('n_in')} / max({f.format('n_in')}) OVER w, 9) AS h_in,
               round({f.format('n_out')} / max({f.format('n_out')}) OVER w, 9) AS h_out
        FROM ({_hist_sql(1)}) WINDOW w AS (PARTITION BY frame_id)""")


_OVER = (
    "CAST(floor((coalesce(top_{c}, 0) * top_alpha + coalesce(low_{c}, 0) * low_alpha * (1 - top_alpha))"
    " * per_alpha) AS INTEGER)"
)


def _fit(x, y, w, h, fw, fh, ratio) -> str:
    return X.with_tables("jobs", f"""
        WITH boxes AS (SELECT job_id, CAST(job_id % 50 AS DOUBLE) AS x, CAST(job_id % 40 AS DOUBLE) AS y,
                              CAST(w // 2 AS DOUBLE) AS w, CAST(h // 2 AS DOUBLE) AS h,
                              CAST(w AS DOUBLE) AS fw, CAST(h AS DOUBLE) AS fh FROM jobs),
        t AS (SELECT job_id, {x} AS x, {y} AS y, {w} AS w, {h} AS h, {fw} AS fw, {fh} AS fh FROM boxes),
        r AS (SELECT *, {ratio} AS ar FROM t),
        s1 AS (SELECT *, CASE WHEN w / ar > h THEN h * ar ELSE w END AS w1,
                      CASE WHEN w / ar > h THEN h ELSE w / ar END AS h1 FROM r),
        s2 AS (SELECT *, CASE WHEN w1 > fw THEN fw ELSE w1 END AS w2,
                      CASE WHEN w1 > fw THEN fw / ar ELSE h1 END AS h2 FROM s1),
        s3 AS (SELECT *, CASE WHEN h2 > fh THEN fh * ar ELSE w2 END AS w3,
                      CASE WHEN h2 > fh THEN fh ELSE h2 END AS h3 FROM s2),
        s4 AS (SELECT job_id, x + w / 2 - w3 / 2 AS x, y + h / 2 - h3 / 2 AS y, fw, fh,
                      greatest(1, least(floor(w3 + 0.5::DOUBLE), fw)) AS w,
                      greatest(1, least(floor(h3 + 0.5::DOUBLE), fh)) AS h FROM s3)
        SELECT job_id, CAST(least(fw - w, greatest(0, floor(x + 0.5::DOUBLE))) AS BIGINT) AS x,
               CAST(least(fh - h, greatest(0, floor(y + 0.5::DOUBLE))) AS BIGINT) AS y,
               CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h,
               CAST(fw AS BIGINT) AS fw, CAST(fh AS BIGINT) AS fh FROM s4""")


#: Every span between two anchors of a channel of a generated map.
_SPANS = " UNION ALL ".join(
    f"SELECT '{key}' AS key, {c} AS c, {a[0]!r}::DOUBLE AS x0, {a[1]!r}::DOUBLE AS y0, {b[0]!r}::DOUBLE AS x1, {b[1]!r}::DOUBLE AS y1"
    for key, channels in colormaps.anchors().items() for c, stops in enumerate(channels) for a, b in zip(stops, stops[1:]))
_WAVE = "CAST(round_even(least(1, greatest(0, {})) * 255, 0) AS INTEGER)"

ORACLE = {
    "d1_channel": X.with_tables("pixels", f"SELECT {_COLS}, {_LUMA} AS v FROM pixels"),
    "d2_curve_lut": X.with_tables("curves", """
        WITH nat AS (
            SELECT curve_id, invert, x, CAST(CASE
                WHEN max_x <= min_x THEN CASE WHEN x < max_x THEN 0 ELSE 255 END
                WHEN x <= min_x THEN 0 WHEN x >= max_x THEN 255
                ELSE floor(255 * pow((x - min_x)::DOUBLE / (max_x - min_x)::DOUBLE,
                     ln(least(0.999::DOUBLE, greatest(0.001::DOUBLE, mid_y / 255.0::DOUBLE)))
                     / ln(0.5::DOUBLE)) + 0.5::DOUBLE) END AS INTEGER) AS y
            FROM curves, (SELECT CAST(unnest(range(256)) AS INTEGER) AS x))
        SELECT curve_id, CASE WHEN invert THEN 255 - x ELSE x END AS idx, y,
               NOT invert AND bool_and(x = y) OVER (PARTITION BY curve_id) AS is_identity
        FROM nat"""),
    "d3_apply_curve": X.with_tables("pixels", f"""
        SELECT frame_id, x, y, t[r + 1] AS r, t[g + 1] AS g, t[b + 1] AS b, a
        FROM pixels, (SELECT {_values(STRONG)} AS t)"""),
    "d4_colormap": X.with_tables("pixels", f"""
        SELECT frame_id, x, y, 255 - {_values(STRONG)}[{_LUMA} + 1] AS r, 0 AS g, 0 AS b, a
        FROM pixels"""),
    "d4_all_maps": X.with_tables("pixels", f"""
        WITH levels AS (SELECT CAST({_LUMA} AS INTEGER) AS idx, count(*) AS n FROM pixels GROUP BY ALL),
        spans AS ({_SPANS}),
        parts AS (
            SELECT key, c, idx, CAST(round_even(((idx - x0 * 255) / (x1 * 255 - x0 * 255) * (y1 - y0) + y0) * 255, 0) AS INTEGER) AS v
            FROM spans, levels WHERE idx / 255.0::DOUBLE >= x0 AND (idx / 255.0::DOUBLE < x1 OR (x1 = 1 AND idx = 255)))
        SELECT key AS map_key, idx, n, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b
        FROM parts JOIN levels USING (idx) GROUP BY key, idx, n
        UNION ALL
        SELECT 'rainbow', idx, n, {_WAVE.format("abs(2 * idx / 255.0::DOUBLE - 0.5::DOUBLE)")},
               {_WAVE.format("sin(pi() * idx / 255.0::DOUBLE)")}, {_WAVE.format("cos(pi() * idx / 510.0::DOUBLE)")} FROM levels"""),
    "d4_colormap_fallback": X.with_tables(
        "pixels", "SELECT frame_id, x, y, g AS r, g, g AS b, a FROM pixels"
    ),
    "d5_pixel_effects": X.with_tables("pixels", f"""
        SELECT frame_id, x, y, v AS r, v AS g, v AS b, a
        FROM (SELECT *, {_values(CURVE)}[{_LUMA} + 1] AS v FROM pixels)"""),
    "d6_color_matrix": X.with_tables("pixels", f"""
        SELECT frame_id, x, y,
               {_byte('r * 0.393::DOUBLE + g * 0.769::DOUBLE + b * 0.189::DOUBLE')} AS r,
               {_byte('r * 0.349::DOUBLE + g * 0.686::DOUBLE + b * 0.168::DOUBLE')} AS g,
               {_byte('r * 0.272::DOUBLE + g * 0.534::DOUBLE + b * 0.131::DOUBLE')} AS b, a
        FROM pixels"""),
    "d6_filter_chain": _chain("warm"),
    "d7_histogram256": X.with_tables("cells", _hist_sql(1)),
    "d7_histogram_sampled": X.with_tables("cells", _hist_sql(4)),
    "d8_normalize_hist": _heights_sql("{}::DOUBLE"),
    "d8_normalize_hist_log": _heights_sql("ln(1 + {}::DOUBLE)"),
    "d9_soft_threshold": X.with_tables("pixels", """
        SELECT frame_id, x, y, r, g, b, CAST(floor(a * least(1.0::DOUBLE, greatest(0.0::DOUBLE,
            (0.62::DOUBLE - (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255)
            / (0.62::DOUBLE - (0.62::DOUBLE - 0.35::DOUBLE)))) + 0.5::DOUBLE) AS INTEGER) AS a
        FROM pixels"""),
    "d10_recolor": X.with_tables("pixels", """
        SELECT frame_id, x, y, CASE WHEN a >= 110 THEN 29 ELSE r END AS r,
               CASE WHEN a >= 110 THEN 111 ELSE g END AS g,
               CASE WHEN a >= 110 THEN 214 ELSE b END AS b,
               CASE WHEN a < 110 THEN 0 ELSE a END AS a FROM pixels"""),
    "d11_alpha_flags": X.with_tables("pixels", """
        SELECT frame_id, bool_or(a < 250) AS has_alpha, bit_and(a) <> 255 AS not_opaque
        FROM pixels GROUP BY frame_id"""),
    "d12_composite_over": X.with_tables("pixels", f"""
        WITH base AS MATERIALIZED (SELECT frame_id, x, y, r, g, b, a FROM pixels),
        paired AS MATERIALIZED (
            SELECT coalesce(p.frame_id, t.frame_id + 1) AS fid, coalesce(p.x, t.x) AS cx, coalesce(p.y, t.y) AS cy,
                   p.r AS low_r, p.g AS low_g, p.b AS low_b, p.a AS low_a,
                   t.r AS top_r, t.g AS top_g, t.b AS top_b, t.a AS top_a,
                   coalesce(t.a, 0) * (1.0::DOUBLE / 255) * 0.6::DOUBLE AS top_alpha,
                   coalesce(p.a, 0) * (1.0::DOUBLE / 255) AS low_alpha
            FROM base p FULL JOIN base t ON p.frame_id = t.frame_id + 1 AND p.x = t.x AND p.y = t.y),
        mixed AS (SELECT *, top_alpha + low_alpha * (1 - top_alpha) AS out_alpha FROM paired),
        scaled AS (SELECT *, CASE WHEN out_alpha = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / out_alpha END AS per_alpha
                   FROM mixed)
        SELECT fid AS frame_id, cx AS x, cy AS y,
               CASE WHEN top_a IS NULL THEN low_r ELSE {_OVER.format(c='r')} END AS r,
               CASE WHEN top_a IS NULL THEN low_g ELSE {_OVER.format(c='g')} END AS g,
               CASE WHEN top_a IS NULL THEN low_b ELSE {_OVER.format(c='b')} END AS b,
               CASE WHEN top_a IS NULL THEN low_a ELSE CAST(floor(255 * out_alpha) AS INTEGER) END AS a
        FROM scaled"""),
    "d13_premultiply": X.with_tables("pixels", """
        SELECT frame_id, x, y, CAST(floor(r * (a * (1.0::DOUBLE / 255))) AS INTEGER) AS r,
               CAST(floor(g * (a * (1.0::DOUBLE / 255))) AS INTEGER) AS g,
               CAST(floor(b * (a * (1.0::DOUBLE / 255))) AS INTEGER) AS b, a FROM pixels"""),
    "d13_premultiply_rounded": X.with_tables("pixels", """
        SELECT frame_id, x, y, CASE WHEN a < 128 THEN 0 ELSE r END AS r,
               CASE WHEN a < 128 THEN 0 ELSE g END AS g, CASE WHEN a < 128 THEN 0 ELSE b END AS b,
               CASE WHEN a < 128 THEN 0 ELSE 255 END AS a FROM pixels"""),
    "d14_oval_mask": X.with_tables("pixels", """
        SELECT frame_id, x, y, CASE WHEN i THEN r ELSE 0 END AS r, CASE WHEN i THEN g ELSE 0 END AS g,
               CASE WHEN i THEN b ELSE 0 END AS b, CASE WHEN i THEN a ELSE 0 END AS a
        FROM (SELECT *, (2 * x + 1 - 4) * (2 * x + 1 - 4) + (2 * y + 1 - 4) * (2 * y + 1 - 4) <= 16 AS i
              FROM pixels)"""),
    "e1_crop": X.with_tables("cells", """
        SELECT frame_id, x - 2 AS x, y - 1 AS y, v FROM cells
        WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 5"""),
    "e2_rotate_flip": X.with_tables("cells", "SELECT frame_id, 7 - y AS x, 7 - x AS y, v FROM cells"),
    "e2_rotate_270": X.with_tables("cells", "SELECT frame_id, 7 - y AS x, 7 - x AS y, v FROM cells"),
    "e3_resample": X.with_tables("cells", """
        WITH grid AS (SELECT CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty
                      FROM (SELECT unnest(range(3)) AS tx), (SELECT unnest(range(5)) AS ty)),
        parts AS (
            SELECT frame_id, tx, ty, v,
                   least((x + 1) / 8.0::DOUBLE, (tx + 1) / 3.0::DOUBLE)
                     - greatest(x / 8.0::DOUBLE, tx / 3.0::DOUBLE) AS ox,
                   least((y + 1) / 8.0::DOUBLE, (ty + 1) / 5.0::DOUBLE)
                     - greatest(y / 8.0::DOUBLE, ty / 5.0::DOUBLE) AS oy
            FROM cells, grid)
        SELECT frame_id, tx AS x, ty AS y,
               CAST(floor(sum(v * ox * oy) * 15 + 0.5::DOUBLE + 1e-9::DOUBLE) AS INTEGER) AS v
        FROM parts WHERE ox > 1e-12 AND oy > 1e-12 GROUP BY frame_id, tx, ty"""),
    "e4_fit_boxes": _fit(
        "fh - (fh - (y + h) + h)", "x", "h", "w", "fh", "fw", "9::DOUBLE / 16"
    ),
    "e4_fit_boxes_orig": _fit(
        "fw - (x + w)", "fh - (fh - (y + h) + h)", "w", "h", "fw", "fh", "fw / fh"
    ),
    "e5_trim_bbox": X.with_tables("pixels", """
        WITH box AS (SELECT frame_id, min(x) FILTER (WHERE a > 140) AS x0,
                            max(x) FILTER (WHERE a > 140) AS x1,
                            min(y) FILTER (WHERE a > 140) AS y0,
                            max(y) FILTER (WHERE a > 140) AS y1 FROM pixels GROUP BY frame_id)
        SELECT frame_id, CASE WHEN t THEN x0 ELSE 0 END AS x0, CASE WHEN t THEN y0 ELSE 0 END AS y0,
               CASE WHEN t THEN x1 ELSE 3 END AS x1, CASE WHEN t THEN y1 ELSE 3 END AS y1,
               t AS trimmed
        FROM (SELECT *, coalesce(x1 - x0 < 3 OR y1 - y0 < 3, false) AS t FROM box)"""),
}
