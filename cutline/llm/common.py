"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches and are worked on in slices of a few megabytes, so
that memory follows the slice (or one long text), not the batch or the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.plans.stage import stage

SLICE_BYTES = 2 << 20
SPACE = b" \t\n\v\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns dropped, a null text read as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes of text (a longer text comes alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    end = np.cumsum(np.asarray(size, dtype=np.int64))
    start = 0
    while start < len(end):
        base = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null read as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    col = batch.column(batch.schema.get_field_index(column))
    return [x or "" for x in col.to_pylist()]


def bitmap(cells: DataFrame, log_bits: int, block: int = 16) -> np.ndarray:
    """Bytes in which bit k (little bit first) says whether k is in the int column `cell`.

    Packed in blocks on the executors; the driver receives and holds 2^log_bits bits.
    """

    def pack(batches):
        for batch in batches:
            out = []
            for row in batch.column(1):
                bits = np.zeros(1 << block, np.uint8)
                bits[row.values.to_numpy(zero_copy_only=False)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    blocks = cells.groupBy(F.shiftright("cell", block).alias("block")).agg(
        F.collect_set(F.col("cell").bitwiseAND(F.lit((1 << block) - 1))).alias("cells"))
    return gathered(blocks.mapInArrow(pack, "block int, bits binary"), log_bits, block)


def marked_cells(cells: DataFrame, log_bits: int, block: int = 16) -> np.ndarray:
    """As `bitmap`, for many cells: blocks are packed from sorted cells, no set is held anywhere."""
    size = 1 << block

    def pack(batches):
        now, bits = None, np.zeros(size, np.uint8)

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                names=["block", "bits"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            for part in np.split(cell, np.flatnonzero(np.diff(cell >> block)) + 1):
                if len(part) and part[0] >> block != now:
                    if now is not None:
                        yield row()
                    now, bits[:] = int(part[0] >> block), 0
                bits[part & (size - 1)] = 1
        if now is not None:
            yield row()

    rows = stage(cells.distinct().repartition(F.shiftright("cell", block)).sortWithinPartitions("cell").mapInArrow(
        pack, "block int, bits binary"), "cells")
    return gathered(rows, log_bits, block)


def gathered(rows: DataFrame, log_bits: int, block: int) -> np.ndarray:
    """The 2^log_bits bits of which `rows` (block, bits) hold blocks of 2^block; the others are 0."""
    step = 1 << (block - 3)
    table = np.zeros(max(1 << log_bits, 1 << block) >> 3, np.uint8)
    for r in rows.toLocalIterator():
        table[r.block * step:(r.block + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return table


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand texts over by fewer rows than Spark's thousands, which take much memory."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.set(name, str(rows))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table.append(c)
    digits = f"hex(encode({text}))"
    value = f"CAST(('0x' || substr({digits}, CAST(2 * k + 1 AS INTEGER), 2)) AS BIGINT)"
    given = f"list_transform(range(length({digits}) // 2), lambda k: {value})"
    step = f"xor(c >> 8, CAST({table} AS BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {given}), lambda c, b: {step}))"


class Ids(dict):
    """Consecutive numbers for keys; `keys_new` lists them in order of first sight."""

    def __init__(self):
        super().__init__()
        self.order: list = []

    def __missing__(self, key):
        self[key] = n = len(self.order)
        self.order.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lens[0]], flat[starts[1]:...], ... joined."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    out_start = np.cumsum(lens) - lens
    return flat[np.arange(total) + np.repeat(starts - out_start, lens)]


def segment_sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of each of the consecutive runs of `values`; empty runs give 0."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:], np.float64 if values.dtype.kind == "f"
                                     else np.int64), np.cumsum(values, axis=0)])
    end = np.cumsum(lens)
    return total[end] - total[end - lens]
