"""Inventory of binary containers: chunk rows, checksums and per-file summaries.

Files come as (path, content), for example from `spark.read.format("binaryFile")`.
Walking a container means following offsets through its bytes, which SQL cannot
do; a small Arrow function per grammar returns the chunk list of each file and
everything after that is built-in.  Walkers stop at the first header that does not
fit, so damaged files end early instead of failing the job.

Files are walked in slices of a few megabytes, whose chunks are handed on as columns, so
that a worker's memory follows the slice (or one large file) and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from struct import unpack_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
CHUNK = {
    "pos": pa.int64(), "type": pa.string(), "size": pa.int64(), "hdr": pa.int32(),
    "delay_ms": pa.int64(), "plays": pa.int64(), "alpha": pa.bool_(),
}
CHUNK_COLUMNS = "pos bigint, type string, size bigint, hdr int, delay_ms bigint, plays bigint, alpha boolean"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below `path` as (path, content)."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path).select("path", "content")
    )


def _name(raw: bytes) -> str:
    return raw.decode("latin-1")


def walk_mp4(b: bytes) -> Iterator[tuple]:
    """Top-level atoms; size 1 means a 64-bit size, 0 means up to the end."""
    pos, total = 0, len(b)
    while pos + 8 <= total:
        size, kind, hdr = unpack_from(">I", b, pos)[0], _name(b[pos + 4:pos + 8]), 8
        if size == 1:
            if pos + 16 > total:
                return
            size, hdr = unpack_from(">Q", b, pos + 8)[0], 16
        elif size == 0:
            size = total - pos
        yield pos, kind, size, hdr, None, None, None
        if size <= 0:
            return
        pos += size


def walk_riff(b: bytes) -> Iterator[tuple]:
    """Chunks after the 12-byte head; odd sizes are padded."""
    pos, total = 12, len(b)
    while pos + 8 <= total:
        kind, size = _name(b[pos:pos + 4]), unpack_from("<I", b, pos + 4)[0]
        delay = plays = alpha = None
        if kind == "ANMF" and pos + 23 <= total:
            delay = int.from_bytes(b[pos + 20:pos + 23], "little")
        elif kind == "ANIM" and pos + 14 <= total:
            plays = unpack_from("<H", b, pos + 12)[0]
        elif kind in ("ALPH", "VP8L"):
            alpha = True
        yield pos, kind, size, 8, delay, plays, alpha
        pos += 8 + size + (size & 1)


def walk_png(b: bytes) -> Iterator[tuple]:
    """Chunks after the signature, each with a CRC behind it; IEND is the last."""
    pos, total = 8, len(b)
    while pos + 8 <= total:
        size, kind = unpack_from(">I", b, pos)[0], _name(b[pos + 4:pos + 8])
        delay = plays = alpha = None
        if kind == "acTL" and pos + 16 <= total:
            plays = unpack_from(">I", b, pos + 12)[0]
        elif kind == "fcTL" and pos + 32 <= total:
            num, den = unpack_from(">HH", b, pos + 28)
            delay = int(num / (den or 100) * 1000 + 0.5)
        elif kind == "tRNS":
            alpha = True
        yield pos, kind, size, 8, delay, plays, alpha
        if kind == "IEND":
            return
        pos += size + 12


def _sub_blocks(b: bytes, pos: int) -> int:
    """Position after a run of length-prefixed blocks and its terminator."""
    while pos < len(b) and b[pos]:
        pos += b[pos] + 1
    return pos + 1


def walk_gif(b: bytes) -> Iterator[tuple]:
    """Blocks up to the trailer; an unknown block ends the walk as "error"."""
    total = len(b)
    if total < 13 or b[:3] != b"GIF":
        return
    pos = 13 + (3 << ((b[10] & 7) + 1) if b[10] & 0x80 else 0)
    while pos < total:
        start, block = pos, b[pos]
        kind, hdr, delay, plays, alpha = "error", 1, None, None, None
        if block == 0x3B:
            yield start, "trailer", 1, 1, None, None, None
            return
        if block == 0x2C and pos + 10 <= total:
            packed = b[pos + 9]
            kind, hdr = "image", 10
            pos = _sub_blocks(b, pos + 11 + (3 << ((packed & 7) + 1) if packed & 0x80 else 0))
        elif block == 0x21 and pos + 2 < total:
            label, body = b[pos + 1], b[pos + 3:pos + 3 + b[pos + 2]]
            kind, hdr = {0xF9: "control", 0xFF: "application"}.get(label, "extension"), 3
            if label == 0xF9 and len(body) >= 3:
                delay, alpha = unpack_from("<H", body, 1)[0] * 10, bool(body[0] & 1)
            at = pos + 3 + b[pos + 2]
            if body.startswith(b"NETSCAPE") and b[at:at + 2] == b"\x03\x01" and at + 4 <= total:
                plays = unpack_from("<H", b, at + 2)[0]
            pos = _sub_blocks(b, pos + 2)
        if kind == "error":
            yield start, kind, total - start, 0, None, None, None
            return
        yield start, kind, pos - start, hdr, delay, plays, alpha


WALKERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {
    "mp4": walk_mp4, "riff": walk_riff, "png": walk_png, "gif": walk_gif,
}


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes in `column` (a longer value comes alone)."""
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64))
        start = 0
        while start < len(end):
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def _walked(files: pa.Array, kind: str) -> tuple[list[int], list[pa.Array]]:
    """(chunks of each file, the columns of all chunks)."""
    walk, counts, rows = WALKERS[kind], [], []
    for b in files:
        before = len(rows)
        rows += walk(b.as_py())
        counts.append(len(rows) - before)
    columns = zip(*rows) if rows else [()] * len(CHUNK)
    return counts, [pa.array(c, t) for c, t in zip(columns, CHUNK.values())]


def container_chunks(files: DataFrame, kind: str) -> DataFrame:
    """One row per chunk, atom or block."""

    def run(batches):
        for part in slices(batches, "content"):
            counts, columns = _walked(part["content"], kind)
            path = part["path"].take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([path, *columns], names=["path", *CHUNK])

    return files.select("path", "content").mapInArrow(run, f"path string, {CHUNK_COLUMNS}")


def with_chunk_list(files: DataFrame, kind: str) -> DataFrame:
    """(path, content, chunks): each file with the array of its chunks."""

    def run(batches):
        for part in slices(batches, "content"):
            counts, columns = _walked(part["content"], kind)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=list(CHUNK)))
            yield pa.RecordBatch.from_arrays([part["path"], part["content"], lists], names=["path", "content", "chunks"])

    return files.select("path", "content").mapInArrow(
        run, f"path string, content binary, chunks array<struct<{CHUNK_COLUMNS.replace(' ', ':').replace(',:', ',')}>>")


def chunk_crc_audit(files: DataFrame) -> DataFrame:
    """PNG chunks with the CRC-32 of type and data beside the stored one.

    The checksum is taken inside the file's own row, so contents are neither joined
    nor copied per chunk.
    """
    checked = F.expr(
        """transform(filter(chunks, c -> c.pos + 12 + c.size <= octet_length(content)), c -> struct(
             c.pos as pos, c.type as type,
             crc32(substring(content, cast(c.pos + 5 as int), cast(c.size + 4 as int))) as crc,
             cast(conv(hex(substring(content, cast(c.pos + 9 + c.size as int), 4)), 16, 10) as bigint)
                 as stored))"""
    )
    return (
        with_chunk_list(files, "png")
        .select("path", F.inline(checked))
        .withColumn("ok", F.col("crc") == F.col("stored"))
    )


# The chunk type that stands for one frame.
FRAME_TYPES = ["ANMF", "fcTL", "image"]


def container_summary(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, frames, payload bytes, any alpha, plays, total delay."""
    return chunks.groupBy("path").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("type").isin(FRAME_TYPES)).alias("frames"),
        F.sum("size").alias("payload"),
        F.coalesce(F.bool_or("alpha"), F.lit(False)).alias("any_alpha"),
        F.max("plays").alias("plays"),
        F.coalesce(F.sum("delay_ms"), F.lit(0)).alias("total_delay_ms"),
    )


def track_summary(tracks: DataFrame) -> DataFrame:
    """tracks(nb_samples, duration, timescale, codec) with fps and the codec's family."""
    seconds = F.col("duration") / F.col("timescale")
    fps = F.when(F.col("duration") > 0, F.col("nb_samples") / seconds)
    return tracks.withColumns(
        {"fps": fps, "codec_name": F.upper(F.substring_index("codec", ".", 1))}
    )
