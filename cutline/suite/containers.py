"""Registered queries of the container and project sources with their SQL.

Containers are built from the lines of every document, each kind with its own
framing; every 20th file is damaged.  The SQL side never reads the bytes: it adds
up the lengths of the lines.
"""

from __future__ import annotations

import zlib
from struct import pack

import pyarrow as pa
from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.sources import containers as A
from cutline.sources import projects


def _riff(lines: list[bytes], bad: bool) -> bytes:
    out = [b"VP8X" + pack("<I", 10) + bytes(10), b"ANIM" + pack("<IIH", 6, 0, 3)]
    for i, line in enumerate(lines):
        kind = (b"ANMF", b"VP8L", b"XMP ")[i % 3]
        data = bytes(12) + pack("<I", 10 * (i + 1))[:3] + b"\x03" + line if i % 3 == 0 else line
        grown = 1000 if bad and i == len(lines) - 1 else 0
        out.append(kind + pack("<I", len(data) + grown) + data + bytes(len(data) & 1))
    body = b"".join(out)
    return b"RIFF" + pack("<I", 4 + len(body)) + b"WEBP" + body


def _png(lines: list[bytes], bad: bool) -> bytes:
    def chunk(kind: bytes, data: bytes, spoil: int = 0) -> bytes:
        return pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data) ^ spoil)

    out = [chunk(b"IHDR", bytes(13)), chunk(b"acTL", pack(">II", len(lines), 5))]
    for i, line in enumerate(lines):
        out.append(chunk(b"fcTL", bytes(20) + pack(">HH", 10 * (i + 1), 1000) + bytes(2)))
        out.append(chunk(b"tEXt", line, int(bad and i == len(lines) - 1)))
    return b"\x89PNG\r\n\x1a\n" + b"".join(out) + chunk(b"IEND", b"")


def _mp4(lines: list[bytes], bad: bool) -> bytes:
    out = [pack(">I", 16) + b"ftyp" + bytes(8)]
    for i, line in enumerate(lines):
        if i % 5 == 0:
            out.append(pack(">I", 1) + b"free" + pack(">Q", 16 + len(line)) + line)
        else:
            out.append(pack(">I", 8 + len(line)) + b"free" + line)
    return b"".join(out) + (pack(">I", 0) + b"mdat" + bytes(5) if not bad else bytes(3))


def _gif(lines: list[bytes], bad: bool) -> bytes:
    out = [b"GIF89a" + bytes(4) + b"\x80" + bytes(2) + bytes(6)]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + pack("<H", 7) + b"\x00")
    for i, line in enumerate(lines):
        out.append(b"\x21\xf9\x04" + bytes([i % 2]) + pack("<H", i + 1) + b"\x00\x00")
        blocks = [line[j:j + 255] for j in range(0, len(line), 255)]
        out.append(b"\x2c" + bytes(9) + b"\x02" + b"".join(bytes([len(p)]) + p for p in blocks) + b"\x00")
    return b"".join(out) + (b"\x00" if bad else b"\x3b")


BUILDERS = {"riff": _riff, "png": _png, "mp4": _mp4, "gif": _gif}


def files(spark, sf, kind):
    """(path, content) of one container per document."""
    build = BUILDERS[kind]

    def run(batches):
        for part in A.slices(batches, "text"):
            texts, bad = part["text"].cast(pa.binary()).to_pylist(), part["bad"].to_pylist()
            content = pa.array([build(t.split(b"\n"), b) for t, b in zip(texts, bad)], pa.binary())
            yield pa.RecordBatch.from_arrays([part["path"], content], names=["path", "content"])

    return X.table(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(f".{kind}")).alias("path"), "text",
        (F.col("doc_id") % 20 == 0).alias("bad"),
    ).mapInArrow(run, "path string, content binary")


def _chunks(s, d, kind):
    return A.container_chunks(files(s, d, kind), kind).select("path", "pos", "type", "size", "hdr")


def _summary(s, d, kind):
    return A.container_summary(A.container_chunks(files(s, d, kind), kind))


def _a2(s, d):
    return A.chunk_crc_audit(files(s, d, "png")).select("path", "pos", "type", "ok")


def _tracks(s, d):
    """Tracks of every asset from its media samples."""
    per = X.media_samples(s, d).groupBy("asset_id", "track").agg(
        F.count("*").alias("nb_samples"), (F.max("cts") - F.min("cts")).alias("duration"),
        F.max("timescale").alias("timescale"),
    )
    codec = F.when(F.col("track") == "view", "avc1.64001f").otherwise("mp4a.40.2")
    return A.track_summary(per.withColumn("codec", codec))


QUERIES = {
    "a1_riff_chunks": lambda s, d: _chunks(s, d, "riff"),
    "a1_png_chunks": lambda s, d: _chunks(s, d, "png"),
    "a1_mp4_atoms": lambda s, d: _chunks(s, d, "mp4"),
    "a1_gif_blocks": lambda s, d: _chunks(s, d, "gif"),
    "a2_chunk_crc_audit": _a2,
    "a3_riff_summary": lambda s, d: _summary(s, d, "riff"),
    "a3_png_summary": lambda s, d: _summary(s, d, "png"),
    "a3_gif_summary": lambda s, d: _summary(s, d, "gif"),
    "a3_track_summary": _tracks,
    "a5_project_settings": lambda s, d: projects.explode_projects(X.projects(s, d))[0],
    "a5_project_cuts": lambda s, d: projects.explode_projects(X.projects(s, d))[1],
}


def _lines(total: str) -> str:
    """Lines with index i, byte length b, n of their file and bytes before them."""
    return f"""
    cut AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    ln AS (SELECT doc_id, i, n, strlen(line) AS b, doc_id % 20 = 0 AS bad FROM cut),
    pl AS (SELECT *, {total} AS total, CAST(coalesce(sum({total}) OVER (PARTITION BY doc_id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ln)"""


_RIFF_SIZE = "(CASE WHEN i % 3 = 0 THEN b + 16 ELSE b END)"
_RIFF = f"""WITH {_lines(f'8 + {_RIFF_SIZE} + {_RIFF_SIZE} % 2').strip()},
    ch AS (
        SELECT doc_id, 44 + before AS pos, ['ANMF', 'VP8L', 'XMP '][i % 3 + 1] AS type,
               {_RIFF_SIZE} + CASE WHEN bad AND i = n - 1 THEN 1000 ELSE 0 END AS size, i FROM pl
        UNION ALL SELECT doc_id, 12, 'VP8X', 10, NULL FROM documents
        UNION ALL SELECT doc_id, 30, 'ANIM', 6, NULL FROM documents)"""
_PNG = f"""WITH {_lines('50 + b').strip()},
    ch AS (
        SELECT doc_id, 53 + before AS pos, 'fcTL' AS type, 26 AS size, i, true AS ok FROM pl
        UNION ALL SELECT doc_id, 91 + before, 'tEXt', b, NULL, NOT (bad AND i = n - 1) FROM pl
        UNION ALL SELECT doc_id, 8, 'IHDR', 13, NULL, true FROM documents
        UNION ALL SELECT doc_id, 33, 'acTL', 8, NULL, true FROM documents
        UNION ALL SELECT doc_id, max(53 + before + total), 'IEND', 0, NULL, true FROM pl GROUP BY doc_id)"""
_MP4_HDR = "(CASE WHEN i % 5 = 0 THEN 16 ELSE 8 END)"
_MP4 = f"""WITH {_lines(f'{_MP4_HDR} + b').strip()},
    ch AS (
        SELECT doc_id, 16 + before AS pos, 'free' AS type, total AS size, {_MP4_HDR} AS hdr FROM pl
        UNION ALL SELECT doc_id, 0, 'ftyp', 16, 8 FROM documents
        UNION ALL SELECT doc_id, max(16 + before + total), 'mdat', 13, 8 FROM pl WHERE NOT bad GROUP BY doc_id)"""
_GIF_IMAGE = "(12 + b + (b + 254) // 255)"
_GIF = f"""WITH {_lines(f'8 + {_GIF_IMAGE}').strip()},
    ch AS (
        SELECT doc_id, 38 + before AS pos, 'control' AS type, 8 AS size, 3 AS hdr, i FROM pl
        UNION ALL SELECT doc_id, 46 + before, 'image', {_GIF_IMAGE}, 10, NULL FROM pl
        UNION ALL SELECT doc_id, 19, 'application', 19, 3, NULL FROM documents
        UNION ALL SELECT doc_id, max(38 + before + total), CASE WHEN any_value(bad) THEN 'error' ELSE 'trailer' END,
                         1, CASE WHEN any_value(bad) THEN 0 ELSE 1 END, NULL FROM pl GROUP BY doc_id)"""


def _rows(head: str, kind: str, hdr: str = "8") -> str:
    return f"""{head}
        SELECT doc_id || '.{kind}' AS path, CAST(pos AS BIGINT) AS pos, type,
               CAST(size AS BIGINT) AS size, CAST({hdr} AS INTEGER) AS hdr FROM ch"""


def _sums(head: str, kind: str, frame: str, alpha: str, plays: int, delay: str) -> str:
    return f"""{head}
        SELECT doc_id || '.{kind}' AS path, count(*) AS chunks,
               count(*) FILTER (WHERE type = '{frame}') AS frames, CAST(sum(size) AS BIGINT) AS payload,
               coalesce(bool_or({alpha}), false) AS any_alpha, CAST({plays} AS BIGINT) AS plays,
               CAST(coalesce(sum({delay}), 0) AS BIGINT) AS total_delay_ms
        FROM ch GROUP BY doc_id"""


ORACLE = {
    "a1_riff_chunks": _rows(_RIFF, "riff"),
    "a1_png_chunks": _rows(_PNG, "png"),
    "a1_mp4_atoms": _rows(_MP4, "mp4", "hdr"),
    "a1_gif_blocks": _rows(_GIF, "gif", "hdr"),
    "a2_chunk_crc_audit": f"""{_PNG}
        SELECT doc_id || '.png' AS path, CAST(pos AS BIGINT) AS pos, type, ok FROM ch""",
    "a3_riff_summary": _sums(
        _RIFF, "riff", "ANMF", "type = 'VP8L'", 3, "CASE WHEN type = 'ANMF' THEN 10 * (i + 1) END"
    ),
    "a3_png_summary": _sums(_PNG, "png", "fcTL", "false", 5, "10 * (i + 1)"),
    "a3_gif_summary": _sums(_GIF, "gif", "image", "i % 2 = 1", 7, "10 * (i + 1)"),
    "a3_track_summary": X.with_tables("media_samples", """
        SELECT *, CASE WHEN duration > 0 THEN nb_samples / (duration / timescale::DOUBLE) END AS fps,
               CASE WHEN track = 'view' THEN 'AVC1' ELSE 'MP4A' END AS codec_name
        FROM (SELECT asset_id, track, count(*) AS nb_samples, max(cts) - min(cts) AS duration,
                     max(timescale) AS timescale,
                     CASE WHEN track = 'view' THEN 'avc1.64001f' ELSE 'mp4a.40.2' END AS codec
              FROM media_samples GROUP BY asset_id, track)"""),
    "a5_project_settings": X.with_tables("assets", """
        SELECT asset_id, 'asset' || asset_id AS name, duration_us AS size, start_us AS mtime,
               asset_id % 30 + 1 AS fps, asset_id % 100 AS quality, 'speed' AS timing_mode,
               in_us AS crop_start, out_us AS crop_end
        FROM assets WHERE asset_id % 10 <> 0"""),
    "a5_project_cuts": X.with_tables("cuts", """
        SELECT asset_id, st_us, en_us FROM cuts WHERE asset_id % 10 <> 0"""),
}
