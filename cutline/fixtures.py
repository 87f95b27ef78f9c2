"""Operator input tables derived from the driver's parquet files.

Each table exists twice: as a Spark frame (`samples(spark, sf)`) and, in `SQL`, as
the query an independent engine runs over the same files.  Time is bigint
microseconds since the epoch everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.numeric import epoch_us
from cutline.plans import scan as S

SECOND = 1_000_000
GAP_36000S = 36_000 * SECOND
GAP_6H = 6 * 3600 * SECOND


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- timelines -------------------------------------------------------------


def samples(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return (events if events is not None else table(spark, sf, "events")).select(
        F.col("user_id").alias("asset_id"),
        F.col("event_id").alias("sample_id"),
        epoch_us(spark, "ts").alias("t_us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def assets(spark: SparkSession, sf: str) -> DataFrame:
    span = samples(spark, sf).groupBy("asset_id").agg(
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us")
    )
    tenth = F.expr("(end_us - start_us) div 10")
    return span.select(
        "asset_id",
        (F.col("start_us") + tenth).alias("in_us"),
        (F.col("end_us") - tenth).alias("out_us"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "start_us",
        "end_us",
    )


def cuts(spark: SparkSession, sf: str) -> DataFrame:
    length = F.floor(F.col("value") * 600).cast("bigint")
    return (
        samples(spark, sf)
        .where((F.col("event_type") == "error") & (length > 0))
        .select(
            "asset_id",
            F.col("t_us").alias("st_us"),
            (F.col("t_us") + length * SECOND).alias("en_us"),
        )
    )


def marks(spark: SparkSession, sf: str) -> DataFrame:
    act = (
        F.when(F.col("event_type") == "click", "arm")
        .when(F.col("event_type") == "purchase", "commit")
        .when(F.col("event_type") == "signup", "clear")
    )
    return (
        samples(spark, sf)
        .select("asset_id", "t_us", "sample_id", act.alias("act"))
        .where("act is not null")
    )


def media_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples in ticks: the track's timescale is fixed by its name."""
    scale = (
        F.when(F.col("event_type") == "view", 90_000)
        .when(F.col("event_type") == "click", 48_000)
        .otherwise(1_000)
        .cast("bigint")
    )
    return samples(spark, sf).select(
        "asset_id",
        "sample_id",
        F.col("event_type").alias("track"),
        scale.alias("timescale"),
        F.expr("(t_us div 1000)").alias("cts_ms"),
        F.col("k"),
    ).select(
        "asset_id", "sample_id", "track", "timescale",
        F.expr("cts_ms * timescale div 1000 + k").alias("cts"),
        F.when(F.col("k") % 3 != 0, (F.col("k") + 1) * 30).alias("dur"),
    )


def measures(spark: SparkSession, sf: str) -> DataFrame:
    byte = F.least(F.lit(255), F.greatest(F.lit(0), F.floor("value"))).cast("int")
    return samples(spark, sf).select("sample_id", "asset_id", byte.alias("b"))


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """One tone curve per asset, taken from the spread of its own measures."""
    per = measures(spark, sf).groupBy("asset_id").agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.sum("b").alias("s"),
        F.count("*").alias("n"),
    )
    return per.select(
        F.col("asset_id").alias("curve_id"),
        F.col("lo").alias("min_x"),
        F.expr("cast(s * 2 div n as int)").alias("mid_y"),
        F.col("hi").alias("max_x"),
        (F.col("asset_id") % 2 == 1).alias("invert"),
    )


# --- cells -----------------------------------------------------------------


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their 64 byte values still packed in one array."""
    scaled = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda d: F.least(
            F.lit(255), F.greatest(F.lit(0), F.floor((d + 1) * 127.5))
        ).cast("int"),
    )
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame_id"),
        F.col("label").cast("bigint").alias("anim_id"),
        scaled.alias("vals"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Packed frames with their sequence number inside the animation."""
    packed = _bytes(spark, sf)
    return S.Scan(packed, ["anim_id"], ["frame_id"]).run(seq=S.row_index()).df


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select(
        "frame_id", "anim_id", "seq", F.posexplode("vals").alias("i", "v")
    ).select(
        "frame_id", "anim_id", "seq",
        (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), "v",
    )


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).select(
        "anim_id", "seq", "x", "y", F.expr("cast(v div 64 as int)").alias("q")
    )


def pixels(spark: SparkSession, sf: str, seq: bool = False) -> DataFrame:
    base = frames(spark, sf) if seq else _bytes(spark, sf)
    four = F.expr(
        "transform(sequence(0, 15), i -> struct(i as i, vals[4*i] as r,"
        " vals[4*i+1] as g, vals[4*i+2] as b, vals[4*i+3] as a))"
    )
    extra = ["seq"] if seq else []
    return base.select("frame_id", "anim_id", *extra, F.explode(four).alias("p")).select(
        "frame_id", "anim_id", *extra,
        (F.col("p.i") % 4).alias("x"), F.expr("cast(p.i div 4 as int)").alias("y"),
        "p.r", "p.g", "p.b", "p.a",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )


# --- jobs, sheets, placements ----------------------------------------------


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "cast(p_partkey as bigint) as job_id",
        "cast(4 * p_size as bigint) as n",
        "cast(64 + 16 * (p_partkey % 200) as bigint) as w",
        "cast(48 + 12 * (p_partkey % 160) as bigint) as h",
        "cast(1 + p_partkey % 50 as bigint) as fps",
        "cast(1 + p_partkey % 100 as bigint) as quality",
        "cast(p_size as bigint) * 1000000 as dur_us",
        "cast(1 + p_partkey % 100 as bigint) as target_mb",
        "case when p_partkey % 2 = 0 then 'size' else 'bitrate' end as mode",
        "case when p_partkey % 3 = 0 then 'hevc' else 'avc' end as codec",
    )


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "nation").selectExpr(
        "cast(n_regionkey as bigint) as doc_id", "cast(n_nationkey as bigint) as nk"
    )
    return S.Scan(base, ["doc_id"], ["nk"]).run(ix=S.row_index()).df.selectExpr(
        "doc_id", "ix + 1 as page", "nk",
        "cast(400 + 10 * nk as double) as w", "cast(600 + 5 * nk as double) as h",
        "(nk % 4) * 90 as rot", "cast(nk % 3 as double) as inset",
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    sheet = sheets(spark, sf).select("nk", "doc_id", "page")
    return (
        table(spark, sf, "supplier")
        .join(sheet, F.col("s_nationkey") == F.col("nk"))
        .selectExpr(
            "cast(s_suppkey as bigint) as item_id", "doc_id", "page",
            "cast(s_suppkey % 7 as bigint) as asset_id",
            "cast(pmod(floor(s_acctbal), 400) as double) as x",
            "cast(pmod(floor(s_acctbal * 7), 600) as double) as y",
            "cast(40 as double) as w", "cast(20 as double) as h",
            "cast((s_suppkey % 8) * 45 as double) as rot",
        )
    )


def widgets(spark: SparkSession, sf: str) -> DataFrame:
    """Raw form widgets before classification."""
    return samples(spark, sf).selectExpr(
        "asset_id as doc_id", "1 + k % 7 as page", "sample_id as ord",
        "event_type as name",
        "case when k % 19 = 0 then 'Link' else 'Widget' end as subtype",
        "k % 13 = 0 as hidden", "k % 17 = 0 as push_button",
        "case k % 8 when 0 then 'Sig' when 3 then 'Ch' when 4 then 'Ch'"
        " when 5 then 'Tx' when 6 then 'Tx' else 'Btn' end as field_type",
        "k % 8 = 1 as check_box", "k % 8 = 2 as radio_button",
        "k % 8 = 3 as combo", "k % 8 = 5 as multi_line", "k % 11 = 0 as read_only",
    )


def fields(spark: SparkSession, sf: str) -> DataFrame:
    """Classified fields with a value of the kind's own type."""
    return samples(spark, sf).selectExpr(
        "asset_id as doc_id", "1 + k % 7 as page", "sample_id as ord",
        "event_type as name",
        "element_at(array('sig', 'checkbox', 'radio', 'list', 'text'), cast(k % 5 as int) + 1)"
        " as kind",
        "case when k % 5 = 1 then k % 2 = 0 end as v_bool",
        "case when k % 5 in (2, 4) and k % 4 <> 0 then cast(k as string)"
        " when k % 5 = 4 then '' end as v_str",
        "case when k % 5 = 3 then case when k % 3 = 0 then cast(array() as array<string>)"
        " else array(cast(k as string)) end end as v_arr",
        "k % 11 = 0 as read_only", "k",
    )


# --- text ------------------------------------------------------------------


def posts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2016-01-01").cast("date"), (F.col("doc_id") % 900).cast("int"))
    return table(spark, sf, "documents").select(
        F.concat(
            F.lit("_posts/"), F.date_format(day, "yyyy-MM-dd"), F.lit("-"),
            F.col("doc_id").cast("string"), F.lit(".md"),
        ).alias("path"),
        F.concat(
            F.lit("---\ntitle: Entry "), F.col("doc_id").cast("string"),
            F.lit("\nlang: "), F.col("lang"), F.lit("\n---\n"), F.col("text"),
        ).alias("content"),
    )


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """Saved-settings JSON per asset, which lists its cuts; assets divisible by 10 hold junk."""
    listed = cuts(spark, sf).groupBy("asset_id").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("st_us").alias("start"), F.col("en_us").alias("end")))
        ).alias("cuts")
    )
    doc = F.to_json(
        F.struct(
            F.lit(1).alias("v"),
            F.struct(
                F.concat(F.lit("asset"), F.col("asset_id")).alias("name"),
                F.col("duration_us").alias("size"),
                F.col("start_us").alias("lastModified"),
            ).alias("file"),
            F.struct(
                (F.col("asset_id") % 30 + 1).alias("fps"),
                (F.col("asset_id") % 100).alias("quality"),
                F.lit("speed").alias("timingMode"),
            ).alias("general"),
            F.struct(
                F.col("in_us").alias("cropStart"), F.col("out_us").alias("cropEnd"),
                F.coalesce(
                    "cuts", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
                ).alias("cuts"),
            ).alias("video"),
        )
    )
    return (
        assets(spark, sf)
        .join(listed, "asset_id", "left")
        .select(
            "asset_id",
            F.when(F.col("asset_id") % 10 == 0, F.lit("{broken")).otherwise(doc).alias("json"),
        )
    )


SQL = {
    "samples": """
        SELECT user_id AS asset_id, event_id AS sample_id, epoch_us(ts) AS t_us, event_type,
               value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "assets": """
        SELECT asset_id, t0 + (t1 - t0) // 10 AS in_us, t1 - (t1 - t0) // 10 AS out_us,
               t1 - t0 AS duration_us, t0 AS start_us, t1 AS end_us
        FROM (SELECT asset_id, min(t_us) AS t0, max(t_us) AS t1 FROM samples GROUP BY asset_id)""",
    "cuts": """
        SELECT asset_id, t_us AS st_us,
               t_us + CAST(floor(value * 600) AS BIGINT) * 1000000 AS en_us
        FROM samples WHERE event_type = 'error' AND floor(value * 600) > 0""",
    "marks": """
        SELECT asset_id, t_us, sample_id,
               CASE event_type WHEN 'click' THEN 'arm' WHEN 'purchase' THEN 'commit'
                    ELSE 'clear' END AS act
        FROM samples WHERE event_type IN ('click', 'purchase', 'signup')""",
    "media_samples": """
        SELECT asset_id, sample_id, track, timescale,
               (t_us // 1000) * timescale // 1000 + k AS cts,
               CASE WHEN k % 3 <> 0 THEN (k + 1) * 30 END AS dur
        FROM (SELECT asset_id, sample_id, event_type AS track, t_us, k,
                     CAST(CASE event_type WHEN 'view' THEN 90000 WHEN 'click' THEN 48000
                          ELSE 1000 END AS BIGINT) AS timescale FROM samples)""",
    "measures": """
        SELECT sample_id, asset_id,
               CAST(least(255, greatest(0, floor(value))) AS INTEGER) AS b FROM samples""",
    "curves": """
        SELECT asset_id AS curve_id, min(b) AS min_x,
               CAST(sum(b) * 2 // count(*) AS INTEGER) AS mid_y, max(b) AS max_x,
               asset_id % 2 = 1 AS invert
        FROM measures GROUP BY asset_id""",
    "frame_bytes": """
        SELECT vec_id AS frame_id, CAST(label AS BIGINT) AS anim_id,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq,
               list_transform(CAST(embedding AS DOUBLE[]), lambda d:
                   CAST(least(255, greatest(0, floor((d + 1) * 127.5))) AS INTEGER)) AS vals
        FROM embeddings""",
    "cells": """
        SELECT frame_id, anim_id, seq, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
               vals[i + 1] AS v
        FROM frame_bytes, (SELECT unnest(range(64)) AS i)""",
    "levels": """
        SELECT anim_id, seq, x, y, CAST(v // 64 AS INTEGER) AS q FROM cells""",
    "pixels": """
        SELECT frame_id, anim_id, seq, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 AS INTEGER) AS y,
               vals[4 * i + 1] AS r, vals[4 * i + 2] AS g, vals[4 * i + 3] AS b, vals[4 * i + 4] AS a
        FROM frame_bytes, (SELECT unnest(range(16)) AS i)""",
    "vectors": """
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "jobs": """
        SELECT CAST(p_partkey AS BIGINT) AS job_id, CAST(4 * p_size AS BIGINT) AS n,
               CAST(64 + 16 * (p_partkey % 200) AS BIGINT) AS w,
               CAST(48 + 12 * (p_partkey % 160) AS BIGINT) AS h,
               CAST(1 + p_partkey % 50 AS BIGINT) AS fps,
               CAST(1 + p_partkey % 100 AS BIGINT) AS quality,
               CAST(p_size AS BIGINT) * 1000000 AS dur_us,
               CAST(1 + p_partkey % 100 AS BIGINT) AS target_mb,
               CASE WHEN p_partkey % 2 = 0 THEN 'size' ELSE 'bitrate' END AS mode,
               CASE WHEN p_partkey % 3 = 0 THEN 'hevc' ELSE 'avc' END AS codec
        FROM part""",
    "sheets": """
        SELECT CAST(n_regionkey AS BIGINT) AS doc_id,
               row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS page,
               CAST(n_nationkey AS BIGINT) AS nk,
               CAST(400 + 10 * n_nationkey AS DOUBLE) AS w,
               CAST(600 + 5 * n_nationkey AS DOUBLE) AS h,
               CAST((n_nationkey % 4) * 90 AS BIGINT) AS rot,
               CAST(n_nationkey % 3 AS DOUBLE) AS inset
        FROM nation""",
    "items": """
        SELECT CAST(s_suppkey AS BIGINT) AS item_id, doc_id, page,
               CAST(s_suppkey % 7 AS BIGINT) AS asset_id,
               CAST(((CAST(floor(s_acctbal) AS BIGINT) % 400) + 400) % 400 AS DOUBLE) AS x,
               CAST(((CAST(floor(s_acctbal * 7) AS BIGINT) % 600) + 600) % 600 AS DOUBLE) AS y,
               CAST(40 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h,
               CAST((s_suppkey % 8) * 45 AS DOUBLE) AS rot
        FROM supplier JOIN sheets ON s_nationkey = nk""",
    "widgets": """
        SELECT asset_id AS doc_id, 1 + k % 7 AS page, sample_id AS ord, event_type AS name,
               CASE WHEN k % 19 = 0 THEN 'Link' ELSE 'Widget' END AS subtype,
               k % 13 = 0 AS hidden, k % 17 = 0 AS push_button,
               CASE k % 8 WHEN 0 THEN 'Sig' WHEN 3 THEN 'Ch' WHEN 4 THEN 'Ch'
                    WHEN 5 THEN 'Tx' WHEN 6 THEN 'Tx' ELSE 'Btn' END AS field_type,
               k % 8 = 1 AS check_box, k % 8 = 2 AS radio_button, k % 8 = 3 AS combo,
               k % 8 = 5 AS multi_line, k % 11 = 0 AS read_only
        FROM samples""",
    "fields": """
        SELECT asset_id AS doc_id, 1 + k % 7 AS page, sample_id AS ord, event_type AS name,
               ['sig', 'checkbox', 'radio', 'list', 'text'][k % 5 + 1] AS kind,
               CASE WHEN k % 5 = 1 THEN k % 2 = 0 END AS v_bool,
               CASE WHEN k % 5 IN (2, 4) AND k % 4 <> 0 THEN CAST(k AS VARCHAR)
                    WHEN k % 5 = 4 THEN '' END AS v_str,
               CASE WHEN k % 5 = 3 THEN CASE WHEN k % 3 = 0 THEN CAST([] AS VARCHAR[])
                    ELSE [CAST(k AS VARCHAR)] END END AS v_arr,
               k % 11 = 0 AS read_only, k
        FROM samples""",
    "posts": """
        SELECT '_posts/' || strftime(DATE '2016-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d')
                   || '-' || doc_id || '.md' AS path,
               '---' || chr(10) || 'title: Entry ' || doc_id || chr(10) || 'lang: ' || lang
                   || chr(10) || '---' || chr(10) || text AS content
        FROM documents""",
    "clipped": """
        SELECT asset_id, a AS st_us, b AS en_us FROM (
            SELECT asset_id, greatest(least(st_us, out_us), in_us) AS a,
                   greatest(least(en_us, out_us), in_us) AS b
            FROM cuts JOIN assets USING (asset_id))
        WHERE b - a > 1000""",
    "edges": """
        SELECT asset_id, in_us, out_us, a, b,
               max(b) OVER (PARTITION BY asset_id ORDER BY a, b
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM (SELECT asset_id, in_us, out_us, greatest(least(st_us, out_us), in_us) AS a,
                     greatest(least(en_us, out_us), in_us) AS b
              FROM cuts JOIN assets USING (asset_id)
              UNION ALL SELECT asset_id, in_us, out_us, out_us, out_us FROM assets)""",
    "keep": """
        SELECT asset_id, coalesce(reach, in_us) AS st_us, a AS en_us
        FROM edges WHERE a > coalesce(reach, in_us)""",
    "kept_acc": """
        SELECT asset_id, st_us, en_us,
               CAST(coalesce(sum(en_us - st_us) OVER (PARTITION BY asset_id ORDER BY st_us
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS acc
        FROM keep""",
}

NEEDS = {
    "samples": [], "assets": ["samples"], "cuts": ["samples"], "marks": ["samples"],
    "media_samples": ["samples"], "measures": ["samples"], "curves": ["measures"],
    "frame_bytes": [], "cells": ["frame_bytes"], "levels": ["cells"], "pixels": ["frame_bytes"],
    "vectors": [], "jobs": [], "sheets": [], "items": ["sheets"], "widgets": ["samples"],
    "fields": ["samples"], "posts": [],
    "clipped": ["cuts", "assets"], "edges": ["cuts", "assets"], "keep": ["edges"],
    "kept_acc": ["keep"],
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """Prefix `body` with the WITH clause that defines the named tables."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS[name]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{head}{parts},\n{body[5:]}"
    return f"{head}{parts}\n{body}"
