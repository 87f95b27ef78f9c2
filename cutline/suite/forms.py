"""Registered queries of the form and placement family with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import forms as H

HANDLES = [(0, 0), (128, 128), (255, 255)]


def _values(s, d):
    return H.field_values(X.fields(s, d))


def _raw(s, d):
    """Fields with values as a document stores them."""
    return X.fields(s, d).selectExpr(
        "doc_id", "page", "ord", "name", "kind",
        "case k % 6 when 0 then null when 1 then 'Off' when 2 then 'Yes' when 3 then '' else cast(k as string) end as raw_str",
        "case when kind = 'list' and k % 4 = 0 then array(cast(k as string), 'b') end as raw_arr",
        "case when k % 7 > 3 then 'Yes' end as export_value")


def _shown(values):
    """Arrays as text, so both engines hash the same bytes."""
    return values.withColumn("v_arr", F.array_join("v_arr", ","))


def _edited(values):
    """An edit of every third document."""
    mine = F.col("doc_id") % 3 == 0
    return values.withColumns(
        {
            "v_bool": F.when(mine, ~F.col("v_bool")).otherwise(F.col("v_bool")),
            "v_arr": F.when(mine, F.array_append("v_arr", "new")).otherwise(F.col("v_arr")),
            "v_str": F.when(mine & (F.col("kind") == "text"), F.concat("v_str", F.lit("x"))).otherwise(
                F.col("v_str")
            ),
        }
    )


def _h4(s, d):
    values = _values(s, d)
    return H.changed_fields(values, _edited(values))


def _h5(s, d):
    looks = F.expr(
        """transform(sequence(0L, k % 3), i -> struct((k + i) % 7 <> 0 as present,
           if((k + i) % 5 = 0, null, (k * (i + 1)) % 60) as stream_len))"""
    )
    rows = X.fields(s, d).withColumn("appearances", looks).withColumn(
        "need_appearances", F.col("doc_id") % 10 == 0
    )
    return H.stale_fields(rows).select("doc_id", "page", "ord", "name", "kind")


def _h6(s, d):
    rows = X.fields(s, d).selectExpr(
        "doc_id", "ord", "concat(name, '-', ord) as name", "k % 9 <> 0 as ok", "k % 4 as subs"
    )
    return H.write_report(rows)


def _sheets(s, d):
    return X.sheets(s, d).selectExpr(
        "doc_id", "page", "rot", "0D as mb_x", "0D as mb_y", "w as mb_w", "h as mb_h",
        "inset as cb_x", "inset as cb_y", "w - 2 * inset as cb_w", "h - 2 * inset as cb_h",
        "if(rot in (90, 270), h, w) as disp_w", "if(rot in (90, 270), w, h) as disp_h",
    )


def _items(s, d):
    return X.items(s, d).drop("asset_id")


def _h9(s, d):
    out = H.to_page_space(_items(s, d), _sheets(s, d))
    rounded = {c: F.round(c, 6) for c in ("origin_x", "origin_y", "draw_w", "draw_h")}
    turn = F.pmod(F.round("deg", 6) + 360, F.lit(360.0))
    return out.withColumns({**rounded, "deg": F.round(turn, 5)})


def _owned(s, d):
    return X.table(s, d, "supplier").selectExpr("cast(s_suppkey % 7 as bigint) as asset_id").distinct()


def _h11(s, d):
    options = F.expr(
        """transform(sequence(0L, k % 4), i -> struct(cast(k + i + k % 2 as string) as value,
           concat('label', i) as label))"""
    )
    rows = X.fields(s, d).where("v_arr is not null").withColumn("options", options)
    return H.off_list_values(rows)


def _h12(s, d):
    targets = X.sheets(s, d).selectExpr("doc_id", "page as ord", "(page - 1) * 500 + h / 2 as pos")
    points = X.items(s, d).selectExpr("doc_id", "item_id as point_id", "x * 7 + y as pos")
    return H.nearest(points, targets)


def _h12_plane(s, d):
    """For the second pair of every vector's values the vector whose first pair is closest."""
    at = lambda a, b: [F.col("embedding")[a].cast("double").alias("px"), F.col("embedding")[b].cast("double").alias("py")]
    rows = X.vectors(s, d)
    points, targets = rows.select("vec_id", *at(2, 3)), rows.select(F.col("vec_id").alias("ord"), *at(0, 1))
    return H.nearest_in_plane(points, targets).select("vec_id", "ord", F.round("distance", 9).alias("distance"))


QUERIES = {
    "h12_nearest_in_plane": _h12_plane,
    "h2_typed_values": lambda s, d: _shown(H.typed_values(_raw(s, d))),
    "h1_classify_fields": lambda s, d: H.classify_fields(X.widgets(s, d)).select(
        "doc_id", "page", "ord", "name", "kind", "read_only"
    ),
    "h2_field_values": lambda s, d: _shown(_values(s, d)),
    "h3_form_fill_stats": lambda s, d: H.form_fill_stats(X.fields(s, d), _values(s, d)),
    "h4_changed_fields": _h4,
    "h5_stale_fields": _h5,
    "h6_write_report": _h6,
    "h7_copy_to_all_pages": lambda s, d: H.copy_to_all_pages(_items(s, d), _sheets(s, d)),
    "h8_clamp_to_page": lambda s, d: H.clamp_to_page(_items(s, d), _sheets(s, d)),
    "h8_clamp_with_slack": lambda s, d: H.clamp_to_page(_items(s, d), _sheets(s, d), keep=14),
    "h9_to_page_space": _h9,
    "h10_asset_usage": lambda s, d: H.asset_usage(X.items(s, d), _owned(s, d)),
    "h10_drop_assets": lambda s, d: H.drop_assets(
        X.items(s, d), _owned(s, d).where("asset_id % 3 = 0")
    ).select("item_id", "doc_id", "asset_id"),
    "h11_off_list_values": _h11,
    "h12_nearest": _h12,
    "h12_nearest_handle": lambda s, d: H.nearest_handle(
        X.items(s, d).selectExpr("item_id", "x * 0.64D as px", "y * 0.425D as py"), HANDLES
    ),
}

_FIRST = """
    vals AS (
        SELECT doc_id, name, first.kind AS kind, first.b AS v_bool, first.s AS v_str, first.a AS v_arr,
               last.p AS meta_page, last.o AS meta_ord, last.k AS meta_kind
        FROM (SELECT doc_id, name,
                     arg_min(struct_pack(kind := kind, b := v_bool, s := v_str, a := v_arr),
                             page * 1000000000 + ord) AS first,
                     arg_max(struct_pack(p := page, o := ord, k := kind), page * 1000000000 + ord)
                         FILTER (WHERE kind <> 'sig' AND NOT read_only) AS last
              FROM fields GROUP BY doc_id, name))"""

_PAGES = """
    pg AS (SELECT doc_id, page, rot AS turn, w, h, inset,
                  CASE WHEN rot IN (90, 270) THEN h ELSE w END AS disp_w,
                  CASE WHEN rot IN (90, 270) THEN w ELSE h END AS disp_h FROM sheets)"""


def _clamp_sql(slack: str) -> str:
    return X.with_tables("items sheets", f"""
        WITH {_PAGES.strip()}
        SELECT item_id, doc_id, page, least(greatest(-sl, disp_w - w + sl), greatest(-sl, x)) AS x,
               least(greatest(-sl, disp_h - h + sl), greatest(-sl, y)) AS y, w, h, rot
        FROM (SELECT i.*, disp_w, disp_h, {slack} AS sl FROM items i
              JOIN (SELECT doc_id, page, disp_w, disp_h FROM pg) USING (doc_id, page))""")


_MAP = """CASE turn WHEN 90 THEN {a} WHEN 180 THEN {b} WHEN 270 THEN {c} ELSE {d} END"""
_MX = _MAP.format(a="inset + {y}", b="inset + vw - {x}", c="inset + vw - {y}", d="inset + {x}")
_MY = _MAP.format(a="inset + {x}", b="inset + {y}", c="inset + vh - {x}", d="inset + vh - {y}")

ORACLE = {
    "h1_classify_fields": X.with_tables("widgets", """
        SELECT doc_id, page, ord, name, kind, read_only FROM (
            SELECT *, CASE WHEN field_type = 'Sig' THEN 'sig' WHEN check_box THEN 'checkbox'
                           WHEN radio_button THEN 'radio'
                           WHEN field_type = 'Ch' AND combo THEN 'combo' WHEN field_type = 'Ch' THEN 'list'
                           WHEN multi_line THEN 'multiline' WHEN field_type = 'Tx' THEN 'text' END AS kind
            FROM widgets WHERE subtype = 'Widget' AND NOT hidden AND NOT push_button)
        WHERE kind IS NOT NULL"""),
    "h2_typed_values": X.with_tables("fields", """
        WITH raw AS (
            SELECT doc_id, page, ord, name, kind,
                   CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Off' WHEN 2 THEN 'Yes' WHEN 3 THEN ''
                        ELSE CAST(k AS VARCHAR) END AS v,
                   CASE WHEN kind = 'list' AND k % 4 = 0 THEN CAST(k AS VARCHAR) || ',b' END AS many,
                   CASE WHEN k % 7 > 3 THEN 'Yes' END AS own
            FROM fields)
        SELECT doc_id, page, ord, name, kind,
               CASE WHEN kind = 'checkbox'
                    THEN coalesce(v <> 'Off', false) AND (own IS NULL OR coalesce(v = own, false)) END AS v_bool,
               CASE WHEN kind = 'radio' THEN nullif(v, 'Off')
                    WHEN kind NOT IN ('checkbox', 'combo', 'list') THEN coalesce(v, '') END AS v_str,
               CASE WHEN kind IN ('combo', 'list') THEN coalesce(many, v, '') END AS v_arr
        FROM raw"""),
    "h2_field_values": X.with_tables("fields", f"""
        WITH {_FIRST.strip()}
        SELECT * REPLACE (CASE WHEN v_arr IS NULL THEN NULL WHEN len(v_arr) = 0 THEN ''
                               ELSE array_to_string(v_arr, ',') END AS v_arr) FROM vals"""),
    "h3_form_fill_stats": X.with_tables("fields", f"""
        WITH {_FIRST.strip()},
        ok AS (SELECT doc_id, name, coalesce(v_bool, len(v_arr) > 0, len(v_str) > 0, false) AS filled FROM vals)
        SELECT doc_id,
               count(DISTINCT name) FILTER (WHERE kind <> 'sig' AND NOT read_only) AS fillable,
               count(DISTINCT name) FILTER (WHERE kind <> 'sig' AND NOT read_only AND filled) AS filled,
               count(DISTINCT name) FILTER (WHERE read_only) AS locked,
               count(*) FILTER (WHERE kind = 'sig') AS signatures
        FROM fields JOIN ok USING (doc_id, name) GROUP BY doc_id"""),
    "h4_changed_fields": X.with_tables("fields", f"""
        WITH {_FIRST.strip()}
        SELECT doc_id, name, meta_kind AS kind, 'changed' AS change FROM vals
        WHERE meta_kind IS NOT NULL AND doc_id % 3 = 0
          AND (v_bool IS NOT NULL OR v_arr IS NOT NULL OR (kind = 'text' AND v_str IS NOT NULL))"""),
    "h5_stale_fields": X.with_tables("fields", """
        SELECT doc_id, page, ord, name, kind FROM fields
        WHERE kind <> 'sig' AND (doc_id % 10 = 0 OR len(list_filter(range(k % 3 + 1), lambda i:
            (k + i) % 7 = 0 OR ((k + i) % 5 <> 0 AND (k * (i + 1)) % 60 <= 20))) > 0)"""),
    "h6_write_report": X.with_tables("fields", """
        WITH r AS (SELECT doc_id, ord, name || '-' || ord AS name, k % 9 <> 0 AS ok, k % 4 AS subs FROM fields),
        lost AS (SELECT doc_id, string_agg(name, ', ' ORDER BY ord) AS names FROM (
                     SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn
                     FROM r WHERE NOT ok) WHERE rn <= 4 GROUP BY doc_id)
        SELECT doc_id, written, failed, substituted,
               coalesce(names || CASE WHEN failed > 4 THEN '…' ELSE '' END, '') AS lost
        FROM (SELECT doc_id, count(*) FILTER (WHERE ok) AS written, count(*) FILTER (WHERE NOT ok) AS failed,
                     CAST(coalesce(sum(subs) FILTER (WHERE ok), 0) AS BIGINT) AS substituted
              FROM r GROUP BY doc_id) LEFT JOIN lost USING (doc_id)"""),
    "h7_copy_to_all_pages": X.with_tables("items sheets", f"""
        WITH {_PAGES.strip()}
        SELECT item_id, i.doc_id, t.page,
               least(greatest(0, t.disp_w - i.w), greatest(0, x * (t.disp_w / s.disp_w))) AS x,
               least(greatest(0, t.disp_h - i.h), greatest(0, y * (t.disp_h / s.disp_h))) AS y,
               i.w, i.h, i.rot
        FROM items i JOIN pg s ON s.doc_id = i.doc_id AND s.page = i.page
             JOIN pg t ON t.doc_id = i.doc_id AND t.page <> i.page"""),
    "h8_clamp_to_page": _clamp_sql("0.0::DOUBLE"),
    "h8_clamp_with_slack": _clamp_sql("greatest(0.0::DOUBLE, least(i.w, i.h) - 14)"),
    "h9_to_page_space": X.with_tables("items sheets", f"""
        WITH {_PAGES.strip()},
        a AS (SELECT i.*, turn, inset, disp_w, disp_h, p.w - 2 * inset AS vw, p.h - 2 * inset AS vh,
                     cos(radians(i.rot)) AS co, sin(radians(i.rot)) AS si
              FROM items i JOIN pg p ON p.doc_id = i.doc_id AND p.page = i.page),
        b AS (SELECT *, CASE WHEN turn IN (90, 270) THEN vh ELSE vw END / disp_w AS scale_x,
                     CASE WHEN turn IN (90, 270) THEN vw ELSE vh END / disp_h AS scale_y FROM a),
        c AS (SELECT *, x * scale_x AS dx, y * scale_y AS dy, w * (scale_x + scale_y) / 2 AS dw, h * (scale_x + scale_y) / 2 AS dh FROM b),
        e AS (SELECT *, dx + dw / 2 - dw / 2 * co - dh / 2 * si AS ox,
                     dy + dh / 2 - dw / 2 * si + dh / 2 * co AS oy FROM c),
        f AS (SELECT *, {_MX.format(x='ox', y='oy')} AS origin_x, {_MY.format(x='ox', y='oy')} AS origin_y,
                     {_MX.format(x='(ox + co)', y='(oy + si)')} AS vx,
                     {_MY.format(x='(ox + co)', y='(oy + si)')} AS vy FROM e)
        SELECT item_id, doc_id, page, round(origin_x, 6) AS origin_x, round(origin_y, 6) AS origin_y, round(dw, 6) AS draw_w,
               round(dh, 6) AS draw_h,
               round(fmod(round(degrees(atan2(vy - origin_y, vx - origin_x)), 6) + 360, 360), 5) AS deg FROM f"""),
    "h10_asset_usage": X.with_tables("items", """
        SELECT a.asset_id, count(i.item_id) AS used
        FROM (SELECT DISTINCT CAST(s_suppkey % 7 AS BIGINT) AS asset_id FROM supplier) a
             LEFT JOIN items i ON i.asset_id = a.asset_id GROUP BY a.asset_id"""),
    "h10_drop_assets": X.with_tables("items", """
        SELECT item_id, doc_id, asset_id FROM items WHERE asset_id % 3 <> 0"""),
    "h11_off_list_values": X.with_tables("fields", """
        SELECT doc_id, name, ord, value FROM (
            SELECT doc_id, name, ord, k, unnest(v_arr) AS value FROM fields WHERE v_arr IS NOT NULL)
        WHERE NOT list_contains(list_transform(range(k % 4 + 1), lambda i: CAST(k + i + k % 2 AS VARCHAR)), value)"""),
    "h12_nearest": X.with_tables("items sheets", """
        SELECT i.doc_id, item_id AS point_id, x * 7 + i.y AS pos,
               arg_min(pg, struct_pack(d := abs((pg - 1) * 500 + ph / 2 - (x * 7 + i.y)), o := pg)) AS ord,
               min(abs((pg - 1) * 500 + ph / 2 - (x * 7 + i.y))) AS distance
        FROM items i JOIN (SELECT doc_id, page AS pg, h AS ph FROM sheets) t USING (doc_id)
        GROUP BY i.doc_id, item_id, x, i.y"""),
    "h12_nearest_in_plane": X.with_tables("vectors", """
        SELECT vec_id, arg_min(ord, struct_pack(d := d, o := ord)) AS ord, round(sqrt(min(d)), 9) AS distance
        FROM (SELECT p.vec_id, t.vec_id AS ord,
                     (p.embedding[3]::DOUBLE - t.embedding[1]::DOUBLE) * (p.embedding[3]::DOUBLE - t.embedding[1]::DOUBLE)
                     + (p.embedding[4]::DOUBLE - t.embedding[2]::DOUBLE) * (p.embedding[4]::DOUBLE - t.embedding[2]::DOUBLE) AS d
              FROM vectors p, vectors t)
        GROUP BY vec_id"""),
    "h12_nearest_handle": X.with_tables("items", """
        SELECT item_id, px, py, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS handle
        FROM (SELECT *, px * px + py * py AS d0, (px - 128) * (px - 128) + (py - 128) * (py - 128) AS d1,
                     (px - 255) * (px - 255) + (py - 255) * (py - 255) AS d2
              FROM (SELECT item_id, x * 0.64::DOUBLE AS px, y * 0.425::DOUBLE AS py FROM items))"""),
}
