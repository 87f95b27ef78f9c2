"""Registered queries of the delta and codebook family with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import codebook as K
from cutline.operators import deltas as N
from cutline.operators import tone as D
from cutline.plans.stage import stage

DIMS = [f"v{i}" for i in range(64)]
RGBA = ["r", "g", "b", "a"]
CODES = 16


def _levels(s, d):
    return stage(X.levels(s, d), "levels")


def _tiles(s, d):
    """Coarse pixels, so that neighbouring frames share many of them."""
    return X.pixels(s, d, seq=True).selectExpr(
        "anim_id", "seq", "x", "y",
        *[f"cast(if(a < 100, 0, {c} div 64) as int) as {c}" for c in "rgb"],
        "if(a < 100, 0, 255) as a",
    )


def _flicker(s, d):
    """Tiles of which all but the first column return every other frame."""
    still = [F.when(F.col("x") == 0, F.col(c)).otherwise(F.when(F.col("seq") % 2 == 0, 0).otherwise(3)).cast("int").alias(c)
             for c in "rgb"]
    return _tiles(s, d).select("anim_id", "seq", "x", "y", *still, F.lit(255).alias("a"))


def _f3(s, d, tiles=_tiles):
    return N.delta_encode(stage(tiles(s, d), "tiles"))


def _last(levels):
    return levels.groupBy("anim_id").agg(F.max("seq").alias("last_seq"))


def _f7(s, d):
    levels = _levels(s, d)
    deltas = stage(N.changed_cells(levels), "deltas")
    return N.replay_kept(deltas, _last(levels))


def _f7_disposed(s, d, tiles=_tiles):
    """Encode, then replay with the blend mode and disposal the encoder chose."""
    deltas = stage(_f3(s, d, tiles), "deltas")
    frames = deltas.groupBy("anim_id", "seq").agg(
        F.min("x").alias("box_x"), F.min("y").alias("box_y"),
        (F.max("x") - F.min("x") + 1).alias("box_w"), (F.max("y") - F.min("y") + 1).alias("box_h"),
        F.max("blend").alias("blend"), F.max("dispose").alias("dispose"),
    )
    return N.replay_disposed(deltas, frames, 4, 4)


def _vec(s, d):
    return X.vectors(s, d).select(
        "vec_id", "label", *[F.col("embedding")[i].alias(c) for i, c in enumerate(DIMS)]
    )


def _f8(s, d):
    out = K.moment_stats(_vec(s, d), DIMS, ["label"])
    return out.select(
        "label", "i", "j", "n", F.round("s", 6).alias("s"), F.round("cov_n", 6).alias("cov_n")
    )


def _means(s, d):
    return _vec(s, d).groupBy(F.col("label").alias("code")).agg(
        *[F.round(F.avg(c), 6).alias(c) for c in DIMS]
    )


def _premultiplied(s, d):
    return D.premultiply(X.pixels(s, d).select("frame_id", "x", "y", *RGBA))


def _book(s, d):
    pixels = stage(_premultiplied(s, d), "pixels")
    return pixels, K.pca_split_codebook(pixels, RGBA, CODES, 1 / 255)


def _f6_tree(s, d):
    pixels, book = _book(s, d)
    return book.assign(pixels).select("frame_id", "x", "y", "code")


def _f6_in_book(s, d):
    pixels, book = _book(s, d)
    return book.nearest(pixels).select("frame_id", "x", "y", "code")


QUERIES = {
    "f6_nearest_in_book": _f6_in_book,
    "f1_change_bbox": lambda s, d: N.change_bbox(_levels(s, d)),
    "f2_best_predecessor": lambda s, d: N.best_predecessor(_levels(s, d)),
    "f3_delta_encode": _f3,
    "f3_delta_flicker": lambda s, d: _f3(s, d, _flicker),
    "f4_palette_stats": lambda s, d: K.palette_stats(X.pixels(s, d)),
    "f4_palette_capped": lambda s, d: K.palette_capped(X.pixels(s, d), ["frame_id"], 12),
    "f4_palette_coarse": lambda s, d: K.palette_stats(
        X.pixels(s, d).selectExpr(
            "frame_id", "r div 64 as r", "g div 64 as g", "b div 64 as b", "a div 64 as a"
        ), ["frame_id"]
    ),
    "f5_pca_split_codebook": lambda s, d: _book(s, d)[1].colors(s),
    "f6_assign_tree": _f6_tree,
    "f6_assign_nearest": lambda s, d: K.assign_nearest(
        _vec(s, d), _means(s, d), DIMS
    ).select("vec_id", "code"),
    "f7_replay_kept": _f7,
    "f7_replay_disposed": _f7_disposed,
    "f7_replay_restored": lambda s, d: _f7_disposed(s, d, _flicker),
    "f8_moment_stats": _f8,
}

_BOX = """
    coalesce(min(x) FILTER (WHERE {c}), 0) AS box_x{t}, coalesce(min(y) FILTER (WHERE {c}), 0) AS box_y{t},
    coalesce(max(x) FILTER (WHERE {c}) - min(x) FILTER (WHERE {c}) + 1, 1) AS box_w{t},
    coalesce(max(y) FILTER (WHERE {c}) - min(y) FILTER (WHERE {c}) + 1, 1) AS box_h{t}"""

_TILES = """
    tiles AS (SELECT anim_id, seq, x, y, CASE WHEN a < 100 THEN 0 ELSE r // 64 END AS r,
                     CASE WHEN a < 100 THEN 0 ELSE g // 64 END AS g,
                     CASE WHEN a < 100 THEN 0 ELSE b // 64 END AS b,
                     CASE WHEN a < 100 THEN 0 ELSE 255 END AS a FROM pixels)"""

_FLICKER = _TILES.replace("tiles AS", "coarse AS") + """,
    tiles AS (SELECT anim_id, seq, x, y, CASE WHEN x = 0 THEN r WHEN seq % 2 = 0 THEN 0 ELSE 3 END AS r,
                     CASE WHEN x = 0 THEN g WHEN seq % 2 = 0 THEN 0 ELSE 3 END AS g,
                     CASE WHEN x = 0 THEN b WHEN seq % 2 = 0 THEN 0 ELSE 3 END AS b, 255 AS a FROM coarse)"""


def _delta_sql(tiles: str) -> str:
    return X.with_tables("pixels", f"""
        WITH {tiles.strip()},
        past AS MATERIALIZED (
            SELECT anim_id, seq, x, y, r, g, b, a, v, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2
            FROM (SELECT *, struct_pack(r := r, g := g, b := b, a := a) AS v FROM tiles)
            WINDOW w AS (PARTITION BY anim_id, x, y ORDER BY seq)),
        boxes AS (SELECT anim_id, seq, {_BOX.format(c='v IS DISTINCT FROM p1', t='1')},
                         {_BOX.format(c='v IS DISTINCT FROM p2', t='2')}
                  FROM past WHERE seq > 0 GROUP BY anim_id, seq),
        sized AS (SELECT *, seq >= 2 AND box_w2 * box_h2 < box_w1 * box_h1 AS better FROM boxes),
        walk AS (
            SELECT anim_id, seq, CASE WHEN better THEN 2 ELSE 1 END AS lag FROM sized WHERE seq = 1
            UNION ALL
            SELECT s.anim_id, s.seq, CASE WHEN s.better AND w.lag = 1 THEN 2 ELSE 1 END
            FROM walk w JOIN sized s ON s.anim_id = w.anim_id AND s.seq = w.seq + 1),
        chosen AS MATERIALIZED (
            SELECT s.anim_id, s.seq, w.lag,
                   CASE WHEN w.lag = 2 THEN box_x2 ELSE box_x1 END AS box_x, CASE WHEN w.lag = 2 THEN box_y2 ELSE box_y1 END AS box_y,
                   CASE WHEN w.lag = 2 THEN box_w2 ELSE box_w1 END AS box_w, CASE WHEN w.lag = 2 THEN box_h2 ELSE box_h1 END AS box_h,
                   CASE WHEN lead(w.lag) OVER (PARTITION BY s.anim_id ORDER BY s.seq) = 2 THEN 2 ELSE 0 END AS dispose
            FROM sized s JOIN walk w USING (anim_id, seq)),
        based AS (SELECT p.*, box_x, box_y, box_w, box_h, dispose, CASE WHEN c.lag = 2 THEN p2 ELSE p1 END AS base
                  FROM past p LEFT JOIN chosen c ON c.anim_id = p.anim_id AND c.seq = p.seq),
        mode AS (SELECT anim_id, seq, bool_or(v IS DISTINCT FROM base AND a < 220 AND base.a > 20) AS copied
                 FROM based WHERE seq > 0 GROUP BY anim_id, seq)
        SELECT anim_id, seq, x, y, CASE WHEN k THEN r ELSE 0 END AS r, CASE WHEN k THEN g ELSE 0 END AS g,
               CASE WHEN k THEN b ELSE 0 END AS b, CASE WHEN k THEN a ELSE 0 END AS a,
               CASE WHEN copied THEN 0 ELSE 1 END AS blend, coalesce(dispose, 0) AS dispose
        FROM (SELECT p.anim_id, p.seq, x, y, r, g, b, a, dispose, p.seq = 0 OR copied AS copied,
                     p.seq = 0 OR copied OR v IS DISTINCT FROM base AS k
              FROM based p LEFT JOIN mode q ON q.anim_id = p.anim_id AND q.seq = p.seq
              WHERE p.seq = 0 OR (x >= box_x AND x < box_x + box_w AND y >= box_y AND y < box_y + box_h))""",
        recursive=True)


def _split_sql(step: int) -> str:
    """Moments and principal axis of all leaves, then the split of the strongest one."""
    d = range(4)
    sums = ", ".join([f"sum({c}) / 255.0::DOUBLE AS m{i}" for i, c in enumerate(RGBA)] + [
        f"sum({RGBA[i]} * {RGBA[j]}) / 65025.0::DOUBLE AS r{i}{j}" for i in d for j in d if i <= j])
    spread = ", ".join(f"r{i}{j} - m{i} * m{j} / n AS s{i}{j}" for i in d for j in d if i <= j)
    turned = ", ".join(" + ".join(f"s{min(i, j)}{max(i, j)} * a{j}" for j in d) + f" AS b{i}" for i in d)
    unit = ", ".join(f"CASE WHEN norm = 0 THEN 0 ELSE b{i} / norm END" for i in d)
    last = ", ".join(f"arg_max(a{i}, it) AS a{i}" for i in d)
    cut = " + ".join(f"a{i} * m{i} / n" for i in d)
    side = " + ".join(f"a{i} * {c} / 255.0::DOUBLE" for i, c in enumerate(RGBA))
    split = f""",
        pick{step} AS MATERIALIZED (SELECT * FROM axis{step} ORDER BY w DESC, leaf LIMIT 1),
        pts{step + 1} AS MATERIALIZED (
            SELECT p.* REPLACE (CASE WHEN p.leaf = k.leaf AND w >= 1e-3 AND NOT ({side} <= cut)
                                THEN {step + 1} ELSE p.leaf END AS leaf)
            FROM pts{step} p, pick{step} k)"""
    return f""",
        mom{step} AS MATERIALIZED (
            SELECT leaf, n, m0, m1, m2, m3, {spread}
            FROM (SELECT leaf, count(*) AS n, {sums} FROM pts{step} GROUP BY leaf)),
        turn{step} AS (
            SELECT leaf, 0 AS it, 0.5::DOUBLE AS a0, 0.5::DOUBLE AS a1, 0.5::DOUBLE AS a2, 0.5::DOUBLE AS a3,
                   0.0::DOUBLE AS w, false AS done FROM mom{step}
            UNION ALL
            SELECT leaf, it + 1, {unit}, CASE WHEN norm = 0 OR abs(norm - w) < 1e-9 THEN w ELSE norm END,
                   norm = 0 OR abs(norm - w) < 1e-9
            FROM (SELECT *, sqrt(b0 * b0 + b1 * b1 + b2 * b2 + b3 * b3) AS norm
                  FROM (SELECT leaf, it, w, {turned} FROM turn{step} JOIN mom{step} USING (leaf)
                        WHERE it < 10 AND NOT done))),
        axis{step} AS MATERIALIZED (
            SELECT *, {cut} AS cut
            FROM (SELECT leaf, {last}, arg_max(w, it) AS w FROM turn{step} GROUP BY leaf) JOIN mom{step} USING (leaf))""" + split


_BOOK = """
    WITH pts0 AS MATERIALIZED (
        SELECT frame_id, x, y, CAST(floor(r * (a * (1.0::DOUBLE / 255))) AS INTEGER) AS r,
               CAST(floor(g * (a * (1.0::DOUBLE / 255))) AS INTEGER) AS g,
               CAST(floor(b * (a * (1.0::DOUBLE / 255))) AS INTEGER) AS b, a, 0 AS leaf FROM pixels)""" + "".join(
    _split_sql(k) for k in range(CODES - 1)) + f""",
        codes AS MATERIALIZED (
            SELECT leaf, CAST(row_number() OVER (ORDER BY n DESC, leaf) - 1 AS INTEGER) AS code, n, mr, mg, mb, ma
            FROM (SELECT leaf, count(*) AS n, sum(r) / 255.0::DOUBLE / count(*) AS mr, sum(g) / 255.0::DOUBLE / count(*) AS mg,
                         sum(b) / 255.0::DOUBLE / count(*) AS mb, sum(a) / 255.0::DOUBLE / count(*) AS ma
                  FROM pts{CODES - 1} GROUP BY leaf))"""


_MOMENTS = """
    , cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS e FROM vectors),
    one AS (SELECT label, i, count(*) AS n, sum(e) AS m FROM cells GROUP BY label, i),
    two AS (SELECT a.label, a.i, b.i AS j, sum(a.e * b.e) AS s
            FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.label, a.i, b.i)
    SELECT two.label, CAST(two.i AS INTEGER) AS i, CAST(two.j AS INTEGER) AS j, p.n, round(s, 6) AS s,
           round(s - p.m * q.m / p.n, 6) AS cov_n
    FROM two JOIN one p ON p.label = two.label AND p.i = two.i JOIN one q ON q.label = two.label AND q.i = two.j"""
_VEC = "v AS (SELECT vec_id, label, " + ", ".join(
    f"embedding[{i + 1}] AS v{i}" for i in range(len(DIMS))
) + " FROM vectors)"

_CENTRES = ", ".join(f"round(avg(v{i}), 6) AS c{i}" for i in range(len(DIMS)))
_DISTANCE = " + ".join(f"(v{i} - c{i}) * (v{i} - c{i})" for i in range(len(DIMS)))

ORACLE = {
    "f1_change_bbox": X.with_tables("levels", f"""
        SELECT c.anim_id, c.seq, {_BOX.format(c='c.q <> p.q', t='').replace('(x)', '(c.x)').replace('(y)', '(c.y)')}
        FROM levels c JOIN levels p
          ON p.anim_id = c.anim_id AND p.x = c.x AND p.y = c.y AND p.seq = c.seq - 1
        GROUP BY c.anim_id, c.seq"""),
    "f2_best_predecessor": X.with_tables("levels", f"""
        WITH past AS (
            SELECT *, lag(q) OVER w AS p1, lag(q, 2) OVER w AS p2 FROM levels
            WINDOW w AS (PARTITION BY anim_id, x, y ORDER BY seq)),
        boxes AS (SELECT anim_id, seq, {_BOX.format(c='q IS DISTINCT FROM p1', t='1')},
                         {_BOX.format(c='q IS DISTINCT FROM p2', t='2')}
                  FROM past WHERE seq > 0 GROUP BY anim_id, seq),
        sized AS (SELECT *, seq >= 2 AND box_w2 * box_h2 < box_w1 * box_h1 AS better FROM boxes),
        walk AS (
            SELECT anim_id, seq, CASE WHEN better THEN 2 ELSE 1 END AS lag FROM sized WHERE seq = 1
            UNION ALL
            SELECT s.anim_id, s.seq, CASE WHEN s.better AND w.lag = 1 THEN 2 ELSE 1 END
            FROM walk w JOIN sized s ON s.anim_id = w.anim_id AND s.seq = w.seq + 1)
        SELECT s.anim_id, s.seq, w.lag,
               CASE WHEN w.lag = 2 THEN box_x2 ELSE box_x1 END AS box_x, CASE WHEN w.lag = 2 THEN box_y2 ELSE box_y1 END AS box_y,
               CASE WHEN w.lag = 2 THEN box_w2 ELSE box_w1 END AS box_w, CASE WHEN w.lag = 2 THEN box_h2 ELSE box_h1 END AS box_h,
               CASE WHEN w.lag = 2 THEN box_w2 * box_h2 ELSE box_w1 * box_h1 END AS area,
               CASE WHEN lead(w.lag) OVER (PARTITION BY s.anim_id ORDER BY s.seq) = 2 THEN 2 ELSE 0 END AS dispose
        FROM sized s JOIN walk w USING (anim_id, seq)""", recursive=True),
    "f3_delta_encode": _delta_sql(_TILES),
    "f3_delta_flicker": _delta_sql(_FLICKER),
    "f4_palette_stats": X.with_tables("pixels", """
        SELECT anim_id, slots, CASE WHEN slots <= 2 THEN 1 WHEN slots <= 4 THEN 2
                   WHEN slots <= 16 THEN 4 ELSE 8 END AS depth, slots <= 256 AS indexed
        FROM (SELECT anim_id, count(DISTINCT (r, g, b, a)) FILTER (WHERE r + g + b + a > 0) + 1 AS slots
              FROM pixels GROUP BY anim_id)"""),
    "f4_palette_capped": X.with_tables("pixels", """
        SELECT frame_id, least(n + 1, 12) AS slots, n + 1 >= 12 AS saturated
        FROM (SELECT frame_id, count(DISTINCT (r, g, b, a)) FILTER (WHERE r + g + b + a > 0) AS n
              FROM pixels GROUP BY frame_id)"""),
    "f4_palette_coarse": X.with_tables("pixels", """
        SELECT frame_id, slots, CASE WHEN slots <= 2 THEN 1 WHEN slots <= 4 THEN 2
                   WHEN slots <= 16 THEN 4 ELSE 8 END AS depth, slots <= 256 AS indexed
        FROM (SELECT frame_id, count(DISTINCT (r // 64, g // 64, b // 64, a // 64))
                     FILTER (WHERE r // 64 + g // 64 + b // 64 + a // 64 > 0) + 1 AS slots
              FROM pixels GROUP BY frame_id)"""),
    "f5_pca_split_codebook": X.with_tables("pixels", _BOOK + """
        SELECT code, n, least(255, CAST(floor(255 * (mr * per) + 0.5::DOUBLE) AS INTEGER)) AS r,
               least(255, CAST(floor(255 * (mg * per) + 0.5::DOUBLE) AS INTEGER)) AS g,
               least(255, CAST(floor(255 * (mb * per) + 0.5::DOUBLE) AS INTEGER)) AS b,
               least(255, CAST(floor(255 * ma + 0.5::DOUBLE) AS INTEGER)) AS a
        FROM (SELECT *, CASE WHEN ma < 0.001 THEN 0 ELSE 1 / ma END AS per FROM codes)""", recursive=True),
    "f6_assign_tree": X.with_tables("pixels", _BOOK + f"""
        SELECT frame_id, x, y, code FROM pts{CODES - 1} JOIN codes USING (leaf)""", recursive=True),
    "f6_nearest_in_book": X.with_tables("pixels", _BOOK + f"""
        SELECT frame_id, x, y, arg_min(code, struct_pack(d := (r / 255.0::DOUBLE - mr) * (r / 255.0::DOUBLE - mr)
            + (g / 255.0::DOUBLE - mg) * (g / 255.0::DOUBLE - mg) + (b / 255.0::DOUBLE - mb) * (b / 255.0::DOUBLE - mb)
            + (a / 255.0::DOUBLE - ma) * (a / 255.0::DOUBLE - ma), c := code)) AS code
        FROM pts{CODES - 1}, codes GROUP BY frame_id, x, y""", recursive=True),
    "f6_assign_nearest": X.with_tables("vectors", f"""
        WITH {_VEC},
        codes AS (SELECT label AS code, {_CENTRES} FROM v GROUP BY label)
        SELECT vec_id, arg_min(code, struct_pack(d := {_DISTANCE}, c := code)) AS code
        FROM v, codes GROUP BY vec_id"""),
    "f7_replay_kept": X.with_tables("levels", "SELECT anim_id, seq, x, y, q FROM levels"),
    "f7_replay_disposed": X.with_tables("pixels", f"""
        WITH {_TILES.strip()} SELECT * FROM tiles"""),
    "f7_replay_restored": X.with_tables("pixels", f"""
        WITH {_FLICKER.strip()} SELECT * FROM tiles"""),
    "f8_moment_stats": X.with_tables("vectors", f"WITH {_VEC} {_MOMENTS}"),
}
