"""Context trees deeper than two bytes, spread over tasks by the three bytes just before (for operator 8).

A byte and the `depth` bytes before it are one code, nearest byte first, so the subtree of three
nearest bytes is a range of codes.  Texts are dealt into buckets of some `BUCKET` bytes; each
asks for its distinct codes, with their counts in training texts.  Codes travel packed, many to
a row, by blocks: a hash of the three nearest bytes.  A task holds one block at a time, mixes its trees from
the deepest node up to three bytes and hands on the weights that the nodes of two bytes need;
those above, bounded by 2^24 trigrams, are mixed on the driver.  Then every block answers
the buckets with the probabilities of their codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import raw, slices
from cutline.plans.stage import stage

END = 0xFF
BUCKET = 24 << 20
BLOCKS = 10


def codes(rows: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of every byte and of the END of each text, length): the bytes before from the top, the byte last."""
    gap, end = bytes([END]) * depth, bytes([END])
    data = np.frombuffer(b"".join([x for t in rows for x in (gap, t, end)]), np.uint8)
    lens = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    keep = np.ones(len(data), bool)
    start = np.cumsum(lens + depth) - lens - depth
    keep[(start[:, None] + np.arange(depth)).ravel()] = False
    n = len(data) - depth
    out = data[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        out |= data[depth - j:depth - j + n].astype(np.uint64) << np.uint64(8 * (depth - j + 1))
    return out[keep[depth:]], lens


def bucket(docs: DataFrame) -> Column:
    """Buckets of about `BUCKET` bytes of text by id and text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // BUCKET + 1)).cast("int")


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, np.concatenate(counts), len(found)).astype(np.int64)


def _packed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def asked(docs: DataFrame, depth: int) -> DataFrame:
    """(bucket, block, codes, counts): the distinct codes of every bucket, and how often training texts have them."""
    shift = np.uint64(8 * (depth - 2))

    def dealt(now, keys, counts):
        found, n = _summed(keys, counts)
        block = ((found >> shift) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BLOCKS)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        found, n, block = found[order], n[order].astype(np.int32), block[order]
        start = np.flatnonzero(np.diff(block, prepend=-1))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(start), now, np.int32)), pa.array(block[start]),
             _packed(np.split(found, start[1:])), _packed(np.split(n, start[1:]))], names=["bucket", "block", "codes", "counts"])

    def run(batches):
        now, keys, counts = None, [], []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for some in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                if not len(some):
                    continue
                if ids[some[0]] != now:
                    if keys:
                        yield dealt(now, keys, counts)
                    now, keys, counts = ids[some[0]], [], []
                for part in slices(batch.slice(some[0], len(some)), "text"):
                    train = ~part.column(1).to_numpy(zero_copy_only=False)
                    code, lens = codes([t.lower() for t in raw(part, "text")], depth)
                    learnt = np.repeat(train, lens)
                    for use, weight in ((learnt, 1), (~learnt, 0)):
                        found, n = np.unique(code[use], return_counts=True)
                        keys.append(found)
                        counts.append(n * weight)
                if len(keys) > 16:
                    found, n = _summed(keys, counts)
                    keys, counts = [found], [n]
        if keys:
            yield dealt(now, keys, counts)

    rows = docs.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "held_out", "text")
    return stage(rows.mapInArrow(run, "bucket int, block int, codes binary, counts binary"), "asked")


def _blocks(batches):
    """(buckets, lists of codes, lists of counts) of each block in sorted rows (bucket, block, codes, counts)."""
    now, held = None, ([], [], [])
    for batch in batches:
        for b, block, c, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if block != now:
                if held[0]:
                    yield held
                now, held = block, ([], [], [])
            held[0].append(b)
            held[1].append(np.frombuffer(c, np.uint64))
            held[2].append(np.frombuffer(n, np.int32))
    if held[0]:
        yield held


def _mixed(keys: np.ndarray, n: np.ndarray, depth: int, block_of):
    """For every bit of a byte: (nodes of three bytes, their log weights, each code's chance of 0, of 1)."""
    for k in range(8):
        bit = (keys >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
        part = (keys & np.uint64(255)) >> np.uint64(8 - k)
        zero = one = weight = first = None
        for d in range(depth, 2, -1):
            node, at, back = np.unique(
                keys >> np.uint64(8 * (depth - d + 1)) << np.uint64(k) | part, return_index=True, return_inverse=True)
            counts = np.stack([np.bincount(back, n * (1 - bit), len(node)), np.bincount(back, n * bit, len(node))], axis=-1)
            own, kt = block_of(counts), (counts + 0.5) / (counts.sum(axis=-1, keepdims=True) + 1)
            if d == depth:
                zero, one, weight = kt[back, 0], kt[back, 1], own
            else:
                weight = np.log(0.5) + np.logaddexp(own, np.bincount(back[first], weight, len(node)))
                stop = np.exp(np.log(0.5) + own - weight)[back]
                zero, one = stop * kt[back, 0] + (1 - stop) * zero, stop * kt[back, 1] + (1 - stop) * one
            first = at
        yield k, node, weight, zero, one


def below(ask: DataFrame, depth: int, block_of) -> DataFrame:
    """(node, weight): the sum of the log weights of the children of each node of two bytes; at most 2^24 rows.

    A node is its two bytes, nearest first, times 255, plus its place in the byte's tree.
    """

    def run(batches):
        for _, keys, counts in _blocks(batches):
            found, n = _summed(keys, counts)
            for k, node, weight, _, _ in _mixed(found, n, depth, block_of):
                top = (node >> np.uint64(k + 8)).astype(np.int64) * 255 + (1 << k) - 1 + (node & np.uint64((1 << k) - 1)).astype(np.int64)
                ids, back = np.unique(top, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int32)), pa.array(np.bincount(back, weight, len(ids)))], names=["node", "weight"])

    rows = ask.repartition("block").sortWithinPartitions("block").select("bucket", "block", "codes", "counts")
    return stage(rows.mapInArrow(run, "node int, weight double").groupBy("node").agg(F.sum("weight").alias("weight")), "below")


def answers(ask: DataFrame, depth: int, block_of, top) -> DataFrame:
    """(bucket, codes, logs): log10 probabilities of all asked codes; `top` is a broadcast of `ctw.top_tree`."""

    def run(batches):
        row_of, zero_top, one_top, rest = top.value
        for buckets, keys, counts in _blocks(batches):
            found, n = _summed(keys, counts)
            near = (found >> np.uint64(8 * (depth - 1))).astype(np.int64)  # nearest byte, then the older one
            row = row_of[(near & 255) << 8 | near >> 8]
            logs = np.zeros(len(found))
            for k, _, _, zero, one in _mixed(found, n, depth, block_of):
                node = (1 << k) - 1 + ((found & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
                bit = (found >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
                logs += np.log10(np.where(bit, one_top[row, node] + rest[row, node] * one, zero_top[row, node] + rest[row, node] * zero))
            logs = logs.astype(np.float32)
            for b, c in zip(buckets, keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), _packed([c]), _packed([logs[np.searchsorted(found, c)]])], names=["bucket", "codes", "logs"])

    rows = ask.repartition("block").sortWithinPartitions("block").select("bucket", "block", "codes", "counts")
    return rows.mapInArrow(run, "bucket int, codes binary, logs binary")


def looked_up(table: pa.Table):
    """A function from codes to their logs, for the answers to one bucket."""
    known = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint64)
    logs = np.frombuffer(b"".join(table.column("logs").to_pylist()), np.float32)
    order = np.argsort(known)
    known, logs = known[order], logs[order]

    def of(code: np.ndarray) -> np.ndarray:
        found, back = np.unique(code, return_inverse=True)
        return logs[np.searchsorted(known, found)][back].astype(np.float64)

    return of

