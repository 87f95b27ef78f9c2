"""Form fields and placements on pages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.numeric import clamp
from cutline.operators.codebook import assign_nearest
from cutline.plans import scan as S
from cutline.plans.topn import first_n

NAME = ["doc_id", "name"]
VALUE = ["v_bool", "v_str", "v_arr"]


def classify_fields(widgets: DataFrame) -> DataFrame:
    """Visible value-carrying widgets with their kind; unknown ones are dropped."""
    shown = (F.col("subtype") == "Widget") & ~F.col("hidden") & ~F.col("push_button")
    if "no_html" in widgets.columns:
        shown = shown & ~F.col("no_html")
    choice = F.when(F.col("combo"), "combo").otherwise("list")
    kind = (
        F.when(F.col("field_type") == "Sig", "sig")
        .when(F.col("check_box"), "checkbox")
        .when(F.col("radio_button"), "radio")
        .when(F.col("field_type") == "Ch", choice)
        .when(F.col("multi_line"), "multiline")
        .when(F.col("field_type") == "Tx", "text")
    )
    return widgets.where(shown).withColumn("kind", kind).where("kind is not null")


def typed_values(fields: DataFrame) -> DataFrame:
    """The raw value of a field as a tagged union by its kind: v_bool, v_str, v_arr.

    Raw values are `raw_str` or, for several choices, `raw_arr`; `export_value` is the
    widget's own name for "on".  A checkbox is true when it has a value other than Off
    that equals its export value (any, if it has none); Off clears a radio button; a
    single choice becomes a list of one; other kinds default to the empty string.
    """
    value, own = F.col("raw_str"), F.col("export_value")
    on = value.isNotNull() & (value != "Off") & (own.isNull() | (value == own))
    choice = F.col("kind").isin("combo", "list")
    many = F.coalesce(F.col("raw_arr"), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))
    radio = F.when(value != "Off", value)
    plain = ~F.col("kind").isin("checkbox", "radio", "combo", "list")
    return fields.withColumns({
        "v_bool": F.when(F.col("kind") == "checkbox", F.coalesce(on, F.lit(False))),
        "v_str": F.when(F.col("kind") == "radio", radio).when(plain, F.coalesce(value, F.lit(""))),
        "v_arr": F.when(choice, many),
    }).drop("raw_str", "raw_arr", "export_value")


def option_pairs(options: Column) -> Column:
    """array<struct<value, label>> in which each of the two stands in for the other if missing."""
    return F.transform(options, lambda o: F.struct(
        F.coalesce(o["value"], o["label"]).alias("value"), F.coalesce(o["label"], o["value"]).alias("label")))


def field_values(fields: DataFrame) -> DataFrame:
    """One row per name: the first widget's value, the last writable one's metadata.

    Values are a tagged union: kind says which of v_bool, v_str, v_arr is set.
    """
    at = F.struct("page", "ord")
    writable = (F.col("kind") != "sig") & ~F.col("read_only")
    first = F.min_by(F.struct("kind", *VALUE), at).alias("first")
    last = F.max_by(F.struct("page", "ord", "kind"), F.when(writable, at)).alias("last")
    return (
        fields.where("name <> ''")
        .groupBy(*NAME)
        .agg(first, last)
        .select(
            *NAME, "first.*", F.col("last.page").alias("meta_page"),
            F.col("last.ord").alias("meta_ord"), F.col("last.kind").alias("meta_kind"),
        )
    )


def _filled() -> Column:
    return F.coalesce(
        F.col("v_bool"), F.array_size("v_arr") > 0, F.length("v_str") > 0, F.lit(False)
    )


def form_fill_stats(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Per document: fillable and filled names, read-only names, signature widgets."""
    fillable = (F.col("kind") != "sig") & ~F.col("read_only")
    names = fields.groupBy(*NAME).agg(
        F.bool_or(fillable).alias("fillable"), F.bool_or("read_only").alias("locked"),
        F.count_if(F.col("kind") == "sig").alias("sigs"),
    )
    known = values.select(*NAME, _filled().alias("filled"))
    return (
        names.join(known, NAME, "left")
        .groupBy("doc_id")
        .agg(
            F.count_if("fillable").alias("fillable"),
            F.count_if(F.col("fillable") & F.col("filled")).alias("filled"),
            F.count_if("locked").alias("locked"),
            F.sum("sigs").alias("signatures"),
        )
    )


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names whose value differs, values compared as JSON.

    Both sides come from `field_values`; read-only and signature fields have no
    metadata there and are left out.  Resetting a form is going back to `before`.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.where("meta_kind is not null").select(
            *NAME, F.col("meta_kind").alias(f"{tag}_kind"),
            F.to_json(F.struct(*VALUE)).alias(f"{tag}_json"),
        )

    both = side(before, "old").join(side(after, "new"), NAME, "full_outer")
    change = (
        F.when(F.col("old_json").isNull(), "added")
        .when(F.col("new_json").isNull(), "removed")
        .otherwise("changed")
    )
    return both.where(~F.col("old_json").eqNullSafe(F.col("new_json"))).select(
        *NAME, F.coalesce("new_kind", "old_kind").alias("kind"), change.alias("change")
    )


def stale_fields(fields: DataFrame, min_stream: int = 20) -> DataFrame:
    """Fields whose stored appearance cannot be trusted.

    fields carry need_appearances and appearances array<struct<present, stream_len>>;
    stream_len is null for per-state dictionaries, which are fine.
    """
    blank = F.exists(
        "appearances",
        lambda a: ~a.present | F.coalesce(a.stream_len <= min_stream, F.lit(False)),
    )
    usable = (F.col("kind") != "sig") & (F.col("name") != "")
    return fields.where(usable & (F.col("need_appearances") | blank))


def write_report(results: DataFrame, show: int = 4) -> DataFrame:
    """results(doc_id, ord, name, ok, subs) summed up per document.

    The first few failed names are cut out by rank before they are gathered, so no
    list grows with the document.
    """
    totals = results.groupBy("doc_id").agg(
        F.count_if("ok").alias("written"), F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("subs"))), F.lit(0)).alias("substituted"),
    )
    lost = (
        first_n(results.where(~F.col("ok")), ["doc_id"], [F.col("ord")], show, "rank")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("lost"))
    )
    names = F.array_join(F.transform("lost", lambda s: s["name"]), ", ")
    dots = F.when(F.col("failed") > show, "…").otherwise("")
    return totals.join(lost, "doc_id", "left").select(
        "doc_id", "written", "failed", "substituted",
        F.coalesce(F.concat(names, dots), F.lit("")).alias("lost"),
    )


def off_list_values(fields: DataFrame) -> DataFrame:
    """Chosen values that are not among options array<struct<value, label>>."""
    odd = F.array_except("v_arr", F.transform("options", lambda o: o["value"]))
    return fields.select("doc_id", "name", "ord", F.explode(odd).alias("value"))


# --- placements ---------------------------------------------------------------


def copy_to_all_pages(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Copies of every placement on the document's other pages, same relative spot."""
    own = sheets.select("doc_id", "page", F.col("disp_w").alias("src_w"), F.col("disp_h").alias("src_h"))
    to = sheets.select("doc_id", F.col("page").alias("to_page"), "disp_w", "disp_h")
    moved = items.join(own, ["doc_id", "page"]).join(to, "doc_id")
    zero = F.lit(0.0)

    def spot(at: str, size: str, src: str, dst: str) -> Column:
        room = F.greatest(zero, F.col(dst) - F.col(size))
        return clamp(F.col(at) * (F.col(dst) / F.col(src)), zero, room)

    return moved.where("to_page <> page").select(
        "item_id", "doc_id", F.col("to_page").alias("page"),
        spot("x", "w", "src_w", "disp_w").alias("x"), spot("y", "h", "src_h", "disp_h").alias("y"),
        "w", "h", "rot",
    )


def clamp_to_page(items: DataFrame, sheets: DataFrame, keep: float | None = None) -> DataFrame:
    """Placements moved onto their sheet; with `keep`, that much must stay visible."""
    dims = sheets.select("doc_id", "page", "disp_w", "disp_h")
    slack = F.lit(0.0)
    if keep is not None:
        slack = F.greatest(F.lit(0.0), F.least("w", "h") - F.lit(float(keep)))

    def held(at: str, size: str, full: str) -> Column:
        return clamp(F.col(at), -slack, F.greatest(-slack, F.col(full) - F.col(size) + slack))

    return items.join(dims, ["doc_id", "page"]).withColumns(
        {"x": held("x", "w", "disp_w"), "y": held("y", "h", "disp_h")}
    ).drop("disp_w", "disp_h")


def to_page_space(items: DataFrame, sheets: DataFrame) -> DataFrame:
    """Origin, size and angle of each placement in the page's own coordinates.

    The visible box is media box ∩ crop box.  The drawn angle comes from mapping
    two points, so page and item rotation are covered together.  Sizes are scaled
    by the mean of the two axis ratios when the displayed size disagrees.
    """
    x0, y0 = F.greatest("mb_x", "cb_x"), F.greatest("mb_y", "cb_y")
    x1 = F.least(F.col("mb_x") + F.col("mb_w"), F.col("cb_x") + F.col("cb_w"))
    y1 = F.least(F.col("mb_y") + F.col("mb_h"), F.col("cb_y") + F.col("cb_h"))
    one = F.lit(1.0)
    page = sheets.select(
        "doc_id", "page", "disp_w", "disp_h", F.pmod(F.col("rot"), F.lit(360)).alias("turn"),
        x0.alias("x0"), y0.alias("y0"),
        F.greatest(one, x1 - x0).alias("vw"), F.greatest(one, y1 - y0).alias("vh"),
    )
    swap = F.col("turn").isin(90, 270)
    rows = items.join(page, ["doc_id", "page"]).withColumns(
        {
            "scale_x": F.when(swap, F.col("vh")).otherwise(F.col("vw")) / F.col("disp_w"),
            "scale_y": F.when(swap, F.col("vw")).otherwise(F.col("vh")) / F.col("disp_h"),
            "co": F.cos(F.col("rot") * F.lit(math.pi) / 180),
            "si": F.sin(F.col("rot") * F.lit(math.pi) / 180),
        }
    )
    rows = rows.withColumn("k", (F.col("scale_x") + F.col("scale_y")) / 2)
    rows = rows.withColumns(
        {
            "dx": F.col("x") * F.col("scale_x"), "dy": F.col("y") * F.col("scale_y"),
            "dw": F.col("w") * F.col("k"), "dh": F.col("h") * F.col("k"),
        }
    )
    # Bottom-left corner, turned about the placement's centre.
    px, py = -F.col("dw") / 2, F.col("dh") / 2
    rows = rows.withColumns(
        {
            "ox": F.col("dx") + F.col("dw") / 2 + px * F.col("co") - py * F.col("si"),
            "oy": F.col("dy") + F.col("dh") / 2 + px * F.col("si") + py * F.col("co"),
        }
    )

    def mapped(lx: Column, ly: Column) -> tuple[Column, Column]:
        def pick(a: Column, b: Column, c: Column, d: Column) -> Column:
            turn = F.col("turn")
            return F.when(turn == 90, a).when(turn == 180, b).when(turn == 270, c).otherwise(d)

        bx, by, w, h = (F.col(c) for c in ("x0", "y0", "vw", "vh"))
        return (
            pick(bx + ly, bx + w - lx, bx + w - ly, bx + lx),
            pick(by + lx, by + ly, by + h - lx, by + h - ly),
        )

    origin_x, origin_y = mapped(F.col("ox"), F.col("oy"))
    vx, vy = mapped(F.col("ox") + F.col("co"), F.col("oy") + F.col("si"))
    return rows.select(
        "item_id", "doc_id", "page", origin_x.alias("origin_x"), origin_y.alias("origin_y"),
        F.col("dw").alias("draw_w"), F.col("dh").alias("draw_h"),
        F.degrees(F.atan2(vy - origin_y, vx - origin_x)).alias("deg"),
    )


def asset_usage(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Placements per asset, 0 included."""
    used = items.groupBy("asset_id").agg(F.count("*").alias("used"))
    return assets.select("asset_id").join(used, "asset_id", "left").select(
        "asset_id", F.coalesce("used", F.lit(0)).alias("used")
    )


def drop_assets(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Placements left after the assets in `ids` are deleted."""
    return items.join(ids.select("asset_id"), "asset_id", "left_anti")


def nearest(points: DataFrame, targets: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """points(key, point_id, pos) with the id of the closest targets(key, ord, pos).

    The closest target is the last one before or the next one after the point, so
    one ordered scan finds both; the lower ord wins ties.
    """
    key = list(key)
    spots = targets.groupBy(*key, "pos").agg(F.min("ord").alias("ord"))
    left = spots.select(*key, "pos", F.struct("pos", "ord").alias("tgt"), F.lit(0).alias("side"))
    right = points.select(*key, "pos", "point_id", F.lit(1).alias("side"))
    both = left.unionByName(right, allowMissingColumns=True)
    hit = S.Scan(both, key, ["pos", "side", "point_id"]).run(
        before=S.last_value(F.col("tgt")), after=S.next_value(F.col("tgt"))
    )

    def far(side: str) -> Column:
        gap = F.abs(F.col(f"{side}.pos") - F.col("pos"))
        found = F.struct(gap.alias("d"), F.col(f"{side}.ord").alias("ord"))
        return F.when(F.col(side).isNotNull(), found)

    best = F.least(far("before"), far("after"))
    return hit.df.where("side = 1").select(
        *key, "point_id", "pos", best.getField("ord").alias("ord"), best.getField("d").alias("distance")
    )


def nearest_in_plane(points: DataFrame, targets: DataFrame) -> DataFrame:
    """points(.., px, py) with the id and distance of the closest of targets(ord, px, py).

    The lower ord wins ties.  Few targets are searched in every task, many in cells of the plane
    that a point leaves only for cells nearer than what it has found; no pairs are formed.
    """
    spots = targets.select(F.col("ord").alias("code"), "px", "py")
    hit = assign_nearest(points, spots, ["px", "py"]).withColumnRenamed("code", "ord")
    at = targets.select("ord", F.col("px").alias("tx"), F.col("py").alias("ty"))
    gap = (F.col("px") - F.col("tx")) * (F.col("px") - F.col("tx")) + (F.col("py") - F.col("ty")) * (F.col("py") - F.col("ty"))
    return hit.join(at, "ord").select(*points.columns, "ord", F.sqrt(gap).alias("distance"))


def nearest_handle(points: DataFrame, handles: Sequence[tuple[float, float]]) -> DataFrame:
    """Index of the closest of a few fixed handles (px, py); the first wins ties."""
    options = []
    for i, (hx, hy) in enumerate(handles):
        dx, dy = F.col("px") - F.lit(float(hx)), F.col("py") - F.lit(float(hy))
        options.append(F.struct((dx * dx + dy * dy).alias("d"), F.lit(i).alias("i")))
    best = options[0] if len(options) == 1 else F.least(*options)
    return points.withColumn("handle", best.getField("i"))
