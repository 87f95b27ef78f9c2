"""Near copies by the Jaccard similarity of word shingles, found exactly.

A text is the set of its lower-cased 5-word shingles.  Two texts are near copies if the
intersection of their sets is at least SHARE (4/5) of the union.

0. Sets.  Every text is split and hashed once; its sorted shingle hashes are stored under the
   hash of the text, and all that follows reads them.
1. Prefixes.  With the shingles of every text in one common order, two such texts share one
   of the first n - ceil(4n/5) + 1 shingles of each, so only these are joined.  The order is
   that of a sample's counts, then of the hashes: shingles of many texts come last.  Any
   order gives the same pairs; the sample and the `heavy` counts only decide how many
   candidates there are.
2. Stars.  Texts that share a prefix shingle are compared with the one where it stands first,
   that is with the text that has fewest rare shingles of its own: the least changed copy.
3. Rest.  Of all other pairs that share one, those not yet in one component are compared.
   Pairs within a component are not even formed, so a crowd of copies costs its stars.

Near copies have nothing in common before the first shingle they share, so behind its places there
is room for the whole intersection.  A row whose own place leaves too little room, even for the
smallest set of its crowd, is dropped, and so is a pair at such places: a text with many
shingles of its own does not meet the crowd of which it is a distant copy.

Candidates are cut by the sizes of the sets and by the places of the shared shingle, then by
counts of hashes in 256 bins, all bounds of the intersection; then the sets themselves decide.

Texts are named by Spark's xxhash64 and their SimHash fingerprint; equal fingerprints are one
node of the components, so exact copies are merged before any comparison.  Texts of fewer
than five words are one shingle, texts without words none.

Edge cases: a null or empty text has no shingle and no link but that of its fingerprint; ids
play no part, so null and repeated ids do no harm; repeated rows are one text; ties in the
order of shingles and of centres go to the smaller hash; an empty table gives no components;
only id and text are read.  A very long text is one set, 8 bytes a distinct shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import gathered, marked_cells, raw, slices, texts
from cutline.llm.components import components
from cutline.llm.windows import Roller, WordHashes, inside
from cutline.plans.stage import stage

SHINGLE = 5
SHARE = (4, 5)
SEED = 42
SAMPLE = 16
HEAVY = 1 << 18
SEEN = 1 << 16
VALUES = 1 << 18
MET_BITS = 26


class _Sets:
    """Sorted distinct shingle hashes of the texts of a slice."""

    def __init__(self, shingle: int):
        self.shingle, self.words, self.roll = shingle, WordHashes(50_000), Roller(0x9FB21C651E98DF25)

    def of(self, rows: list[bytes]) -> list[np.ndarray]:
        split = [t.lower().split() for t in rows]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        values = self.words.of([w for ws in split for w in ws])
        doc, at = inside(lens, self.shingle)
        flat = self.roll.windows(values, self.shingle)[at] if len(at) else at.astype(np.uint64)
        parts = np.split(flat, np.searchsorted(doc, np.arange(1, len(rows)))) if rows else []
        return [
            np.unique(p) if len(p) else np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)] if ws else [], np.uint64)
            for p, ws in zip(parts, split)
        ]


def _new(keys: list[int], seen: set[int]) -> list[int]:
    """Places of keys a task meets for the first time; `seen` is bounded, repeats do no harm."""
    if len(seen) > SEEN:
        seen.clear()
    out = []
    for k, key in enumerate(keys):
        if key not in seen:
            seen.add(key)
            out.append(k)
    return out


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, hashes): the shingle set of every text with words; a text may come from several tasks."""

    def run(batches):
        sets, seen = _Sets(shingle), set()
        for batch in batches:
            for part in slices(batch, "text"):
                data = raw(part, "text")
                keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t in data], np.uint64).view(np.int64)
                fresh = _new(keys.tolist(), seen)
                found = sets.of([data[k] for k in fresh])
                size = np.fromiter(map(len, found), np.int64, len(found))
                if size.any():
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    held = pa.ListArray.from_arrays(ends, np.concatenate(found).view(np.int64))
                    out = pa.RecordBatch.from_arrays([pa.array(keys[fresh]), held], names=["key", "hashes"])
                    yield out.filter(pa.array(size > 0))

    return rows.select("text").mapInArrow(run, "key long, hashes array<long>")


def _lists(batch: pa.RecordBatch):
    """(keys, values joined, values per row) of a batch of sets, some `VALUES` at a time."""
    keys, lists = batch.column(0).to_numpy(), batch.column(1)
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy().view(np.uint64)
    start = 0
    while start < len(keys):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + VALUES, side="right")) - 1)
        yield keys[start:stop], flat[ends[start]:ends[stop]], np.diff(ends[start:stop + 1]).astype(np.int64)
        start = stop


def heavy_shingles(sets: DataFrame, sample: int, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of at most `heavy` shingles, the most frequent in a sample of the texts."""
    picked = sets.where(F.pmod("key", F.lit(sample)) == 0).select(F.explode("hashes").alias("h"))
    counts = stage(picked.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "heavy")
    least, total = 1 << 62, 0
    # distinct counts: their number grows with the root of the sample at most
    for n, times in sorted(((r.n, r.times) for r in counts.groupBy("n").agg(F.count("*").alias("times")).toLocalIterator()), reverse=True):
        total += times
        if total > heavy:
            break
        least = n
    top = counts.where(F.col("n") >= least).toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("n").to_numpy().astype(np.int64)[order]


def _first_shingles(batches, share: tuple[int, int], table):
    """(keys, set sizes, hashes, their rows, their places) of the prefixes in batches of sets."""
    known, count = table.value
    for batch in batches:
        for keys, flat, n in _lists(batch):
            row = np.repeat(np.arange(len(n)), n)
            if len(known):
                spot = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                weight = np.where(known[spot] == flat, count[spot], 0)
                flat = flat[np.lexsort((weight, row))]  # stable: equal counts stay in the order of the hashes
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = n + (-share[0] * n) // share[1] + 1
            use = np.flatnonzero(pos < first[row])
            yield keys, n, flat[use], row[use], pos[use]


def prefixes(sets: DataFrame, share: tuple[int, int], table, only=None, log_bits: int = MET_BITS) -> DataFrame:
    """(h, key, n, pos): the prefix shingles of every text, its set's size and their places.

    `table` is a broadcast of `heavy_shingles`; with the broadcast bitmap `only` just those of marked cells.
    """
    shift = np.uint64(64 - log_bits)

    def run(batches):
        for keys, n, h, row, pos in _first_shingles(batches, share, table):
            if only is not None:
                cell = (h >> shift).astype(np.int64)
                use = (only.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                h, row, pos = h[use], row[use], pos[use]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(keys[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))],
                names=["h", "key", "n", "pos"])

    return sets.select("key", "hashes").mapInArrow(run, "h long, key long, n int, pos int")


def met_cells(sets: DataFrame, share: tuple[int, int], table, log_bits: int = MET_BITS, block: int = 16) -> np.ndarray:
    """Bytes in which bit k says whether cell k has a prefix shingle of more than one row of `sets`.

    Hashes travel many to a row, by blocks of cells, each at most twice from `VALUES` hashes: the
    executors' heap holds few rows, and a shingle of very many texts is no large group.
    """
    size, shift = 1 << block, 64 - log_bits

    def deal(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values = np.repeat(values, np.minimum(n, 2))
        group = (values >> np.uint64(shift + block)).astype(np.int32)
        start = np.flatnonzero(np.diff(group, prepend=-1))
        ends = (np.append(start, len(values)) * 8).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(values)])
        return pa.RecordBatch.from_arrays([pa.array(group[start]), packed], names=["block", "hashes"])

    def run(batches):
        held, n = [], 0
        for _, _, h, _, _ in _first_shingles(batches, share, table):
            held.append(h)
            n += len(h)
            if n >= VALUES:
                yield deal(held)
                held, n = [], 0
        if n:
            yield deal(held)

    def row(now, held):
        values = np.sort(np.concatenate(held))
        bits = np.zeros(size, np.uint8)
        bits[(values[1:][values[1:] == values[:-1]] >> np.uint64(shift)).astype(np.int64) & (size - 1)] = 1
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
            names=["block", "bits"])

    def mark(batches):
        now, held = None, []
        for batch in batches:
            for group, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if group != now:
                    if held:
                        yield row(now, held)
                    now, held = group, []
                held.append(np.frombuffer(packed.as_py(), np.uint64))
        if held:
            yield row(now, held)

    dealt = sets.select("key", "hashes").mapInArrow(run, "block int, hashes binary")
    rows = stage(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(mark, "block int, bits binary"), "cells")
    return gathered(rows, log_bits, block)


def met_prefixes(sets: DataFrame, share: tuple[int, int], sample: int, heavy: int) -> DataFrame:
    """The prefix shingles that more than one row has.

    They are looked for first, by hash alone; a bitmap of their cells, of fixed size, then keeps
    nearly all others out of what is stored.  Its false hits are harmless.
    """
    spark = sets.sparkSession.sparkContext
    table = spark.broadcast(heavy_shingles(sets, sample, heavy))
    only = spark.broadcast(met_cells(sets, share, table))
    rows = stage(prefixes(sets, share, table, only), "prefixes")
    table.unpersist()
    only.unpersist()
    return rows


def _may_fit(share: tuple[int, int]) -> Column:
    """Can the sets of a and b, which share the shingle at these places, be near copies?"""
    most = (F.least("a.pos", "b.pos") + 1
            + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) - 1)
    return most.cast("long") * sum(share) >= (F.col("a.n").cast("long") + F.col("b.n")) * share[0]


def _has_room(share: tuple[int, int]) -> Column:
    """Can the shingle be the first one that this row shares with any of its crowd's, of `least` shingles or more?"""
    n = F.col("n").cast("long")
    return (n - F.col("pos")) * sum(share) >= (n + F.col("least")) * share[0]


def _may_be_first(share: tuple[int, int]) -> Column:
    """Can the shingle at these places be the first one that a and b share, if they are near copies?"""
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return room.cast("long") * sum(share) >= (F.col("a.n").cast("long") + F.col("b.n")) * share[0]


def _bins(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counts of the hashes of every row in 256 bins, at most 255 each."""
    cell = np.repeat(np.arange(len(n)), n) * 256 + (flat & np.uint64(255)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=256 * len(n)), 255).astype(np.uint8).reshape(len(n), 256)
    return [c.tobytes() for c in counts]


def _whole(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    return [p.tobytes() for p in np.split(flat, np.cumsum(n)[:-1])]


def _held(sets: DataFrame, keys: DataFrame, pack, log_bits: int = 23) -> DataFrame:
    """(key, held): `pack` of the sets of the texts in `keys`, once for each text."""
    keys, shift = keys.distinct(), 64 - log_bits
    bits = sets.sparkSession.sparkContext.broadcast(
        marked_cells(keys.select(F.shiftrightunsigned("key", shift).cast("int").alias("cell")), log_bits))

    def run(batches):
        packed = bits.value
        for batch in batches:
            for found, flat, n in _lists(batch):
                spot = (found.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
                hit = (packed[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[hit]), pa.array(pack(flat[np.repeat(hit, n)], n[hit]), pa.binary())], names=["key", "held"])

    held = sets.select("key", "hashes").mapInArrow(run, "key long, held binary").join(keys, "key", "left_semi")
    held = stage(held.dropDuplicates(["key"]), "held")
    bits.unpersist()
    return held


def _most(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of the intersections, sums of the sizes) from bins; a bin at its limit bounds nothing."""
    x = np.frombuffer(b"".join(xs.to_pylist()), np.uint8).reshape(-1, 256)
    y = np.frombuffer(b"".join(ys.to_pylist()), np.uint8).reshape(-1, 256)
    most, both = np.minimum(x, y).sum(axis=1, dtype=np.int64), x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
    full = (x.max(axis=1) == 255) | (y.max(axis=1) == 255)
    return np.where(full, both, most), both


def _shared(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    most, both = np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64)
    for k, (x, y) in enumerate(zip(xs, ys)):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
        most[k], both[k] = np.count_nonzero(y[spot] == x), len(x) + len(y)
    return most, both


def _fitting(pairs: DataFrame, held: DataFrame, count, share: tuple[int, int]) -> DataFrame:
    """The pairs that `count` of what is held of both leaves."""

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.slice(k, 2048)
                most, both = count(part.column(4), part.column(5))
                yield pa.RecordBatch.from_arrays(part.columns[:4], names=["a", "b", "u", "v"]).filter(
                    pa.array(most * sum(share) >= both * share[0]))

    both = (
        pairs.join(held.select(F.col("key").alias("a"), F.col("held").alias("x")), "a")
        .join(held.select(F.col("key").alias("b"), F.col("held").alias("y")), "b")
    )
    return both.select("a", "b", "u", "v", "x", "y").mapInArrow(run, "a long, b long, u long, v long")


def verified(pairs: DataFrame, bins: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(u, v) of the pairs (a, b, u, v) of texts whose sets are near copies."""
    pairs = stage(_fitting(pairs, bins, _most, share), "candidates")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    return _fitting(pairs, _held(sets, keys, _whole), _shared, share).select("u", "v")


def joined(docs: DataFrame, prints: DataFrame, links: DataFrame, shingle: int = SHINGLE,
           share: tuple[int, int] = SHARE, sample: int = SAMPLE, heavy: int = HEAVY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root): components of `links` between fingerprints and of all near copies together.

    `prints` holds (fp, text_key) of every row of `docs`.
    """
    sets = stage(shingle_sets(texts(docs, id_col, text_col), shingle), "sets")
    rows = met_prefixes(sets, share, sample, heavy)
    met = (
        rows.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("n").alias("least"),
                             F.min(F.struct("pos", "key", "n")).alias("b"))
        .where("low < high").select("h", "b", "least")
    )
    names = prints.select(F.col("text_key").alias("key"), "fp").distinct()
    crowds = stage(
        rows.join(met, "h").where(_has_room(share)).join(names, "key").select("h", "key", "fp", "n", "pos", "b").dropDuplicates(["h", "key"]), "crowds")
    bins = _held(sets, crowds.select("key"), _bins)

    ends = [F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("a.fp").alias("u"), F.col("b.fp").alias("v")]
    centre = names.select(F.col("key").alias("centre"), F.col("fp").alias("own"))
    stars = (
        crowds.select("key", "fp", "n", "pos", F.col("b.key").alias("centre"), F.col("b.n").alias("m"), F.col("b.pos").alias("at"))
        .join(centre, "centre")
        .select(F.struct("key", "fp", "n", "pos").alias("a"),
                F.struct(F.col("centre").alias("key"), F.col("own").alias("fp"), F.col("m").alias("n"), F.col("at").alias("pos")).alias("b"))
        .where((F.col("a.fp") != F.col("b.fp")) & _may_fit(share)).select(*ends).distinct()
    )
    roots = stage(components(links.unionByName(verified(stars, bins, sets, share))), "roots")

    placed = stage(
        crowds.join(roots, F.col("fp") == F.col("node"), "left")
        .select("h", "key", "n", "pos", F.coalesce("root", "fp").alias("fp")), "placed")
    present = placed.groupBy("h", F.col("fp").alias("other")).agg(F.lit(1).alias("one")).drop("one")
    rest = (
        placed.join(present, "h").where("fp < other").alias("a")
        .join(placed.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.other") == F.col("b.fp")) & _may_be_first(share))
        .select(*ends).distinct()
    )
    more = verified(rest, bins, sets, share)
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
