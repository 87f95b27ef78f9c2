"""SimHash near-duplicates by pigeonring filtering (operator 10).

A document is reduced to a 64-bit majority fingerprint of its word shingles.  Documents of
one fingerprint are merged first, so all later work is on distinct fingerprints.

The 64 bits form a ring of m segments (m = 2 * radius + 1).  If two fingerprints differ in
at most `radius` bits, then by the pigeonring principle there is a segment from which
*every* chain of 1, 2, ..., m consecutive segments stays within its share of the budget,
floor(length * radius / m) differences.  For radius 2 the shares on 5 segments are 0, 0,
1, 1, 2: two whole segments (25 or 26 bits) agree and serve as join key, the longer chains
prune what the key lets through, and the full distance decides.

Pairs are only formed in key groups of at most `small` fingerprints, so no group gives more
than that many per member.  In larger groups each fingerprint is listed under itself and
all fingerprints one bit away.  Those listed under one value are within two bits of each
other, so linking each to the smallest gives the same components with at most 65 rows a
fingerprint and no pairs; two fingerprints within two bits share such a value.  (For other
radii than 2 the balls have radius / 2 bits, which needs an even radius.)

Edge cases: null and empty texts have fingerprint zero and link like any other; documents
of fewer words than a shingle hash their whole sequence; a null id is kept with its
fingerprint, belongs to its component and counts as larger than every id; repeated rows
share their component; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import raw, read, slices, texts
from cutline.llm.components import components
from cutline.plans.stage import stage

RADIUS = 2
SEED = 42
SMALL = 64
LAST = (1 << 63) - 1  # stands for a null id


def fingerprints_of(rows: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """Majority fingerprints (uint64) of UTF-8 texts."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    lens = np.zeros(len(rows), np.int64)
    for k, text in enumerate(rows):
        words = text.lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(line, seed))
            lens[k] = 1
            continue
        end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        hashes += [digest(line[a:b], seed) for a, b in zip(start[: n - shingle + 1].tolist(), end[shingle - 1:].tolist())]
        lens[k] = n - shingle + 1
    out = np.zeros(len(rows), np.uint64)
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    values = np.array(hashes, "<u8")
    del hashes
    first = (np.cumsum(lens) - lens)[full]
    ones = np.zeros((len(full), 64), np.int64)
    step = 1 << 18  # shingles expanded to bits at a time
    for a in range(0, len(values), step):
        part = values[a:a + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(first, a, side="right")) - 1
        hi = int(np.searchsorted(first, a + len(part), side="left"))
        cuts = np.maximum(first[lo:hi] - a, 0)
        ones[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    major = (2 * ones > lens[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_key): the fingerprint's bits and Spark's xxhash64 of the text, both signed."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = raw(part, "text")
                fp = fingerprints_of(rows, shingle).view(np.int64)
                key = np.array([xxhash.xxh64_intdigest(t, SEED) for t in rows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fp), pa.array(key)], names=["doc_id", "fp", "text_key"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, text_key long")


def segment_bounds(radius: int) -> list[tuple[int, int]]:
    """(start bit, width) of the 2 * radius + 1 segments of the ring."""
    m = 2 * radius + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _ring_keys(radius: int) -> Column:
    """One (turn, key) per start segment: the chain whose budget is zero, as join key."""
    segments = segment_bounds(radius)
    m = len(segments)
    zero = max(n for n in range(1, m + 1) if n * radius // m == 0)
    keys = []
    for turn in range(m):
        key, used = F.lit(0).cast("long"), 0
        for k in range(zero):
            start, width = segments[(turn + k) % m]
            key = key.bitwiseOR(F.shiftleft(_bits(F.col("fp"), start, width), used))
            used += width
        keys.append(F.struct(F.lit(turn).alias("turn"), key.alias("key")))
    return F.array(*keys)


def _chains_fit(diff: Column, turn: Column, radius: int) -> Column:
    """Every chain from segment `turn` stays within its share of the budget."""
    segments = segment_bounds(radius)
    m = len(segments)
    counts = [F.bit_count(_bits(diff, a, w)) for a, w in segments]
    fits = F.lit(False)
    for t in range(m):
        total, ok = F.lit(0), turn == t
        for n in range(1, m + 1):
            total = total + counts[(t + n - 1) % m]
            ok = ok & (total <= n * radius // m)
        fits = fits | ok
    return fits


def links(prints: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(u, v): links whose components are those of all pairs within `radius` bits.

    `prints` holds distinct fingerprints in the column fp.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    keyed = prints.select("fp", F.explode(_ring_keys(radius)).alias("r")).select("fp", "r.turn", "r.key")
    keyed = stage(keyed, "ring")
    size = keyed.groupBy("turn", "key").agg(F.count("*").alias("n")).where("n > 1")
    few, many = size.where(F.col("n") <= small).drop("n"), size.where(F.col("n") > small).drop("n")

    left = keyed.join(few, ["turn", "key"])
    right = left.select("turn", "key", F.col("fp").alias("other"))
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    pairs = (
        left.join(right, ["turn", "key"]).where("fp < other")
        .where(_chains_fit(diff, F.col("turn"), radius))
        .where(F.bit_count(diff) <= radius)
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )

    crowd = keyed.join(many, ["turn", "key"], "left_semi").select("fp").distinct()
    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({f ^ (1 << b) for f in flips for b in range(64)} | set(flips))
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    balls = crowd.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in flips))).alias("centre"))
    low = balls.groupBy("centre").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(low, "centre").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    return pairs.union(stars)


def _named(prints: DataFrame, radius: int, small: int, join=None) -> DataFrame:
    """(fp, first): for each distinct fingerprint the smallest (ord, text_key) of its component.

    `join` makes components of `prints` and the links, if there are further links.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text_key"))
    distinct = prints.groupBy("fp").agg(first.alias("low"))
    near = links(distinct.select("fp"), radius, small)
    roots = join(prints, near) if join else components(near)
    classes = stage(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "classes")
    return classes.join(classes.groupBy("root").agg(F.min("low").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, small: int = SMALL,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document with its group's smallest id."""
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "prints")
    low = F.col("first.ord")
    return prints.join(_named(prints, radius, small), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(low != LAST, low).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, small: int = SMALL,
             id_col: str = "doc_id", text_col: str = "text", join=None) -> DataFrame:
    """One row of `docs` per group: that of the smallest id, of equal ids the smallest text hash, of equal texts any."""
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "prints")
    kept = _named(prints, radius, small, join).select("first.*").distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = {c: F.col(n) for c, n in zip(docs.columns, names)}
    keyed = plain.withColumns({
        "ord": F.coalesce(own[id_col].cast("long"), F.lit(LAST)),
        "text_key": F.xxhash64(F.coalesce(own[text_col].cast("string"), F.lit("")))})
    return keyed.join(kept, ["ord", "text_key"]).dropDuplicates(["ord", "text_key"]).select(*names).toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents at two bits."""
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
