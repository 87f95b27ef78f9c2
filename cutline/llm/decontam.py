"""Benchmark decontamination by template canonicalisation (operator 9).

Words are canonicalised: numbers, names and units become typed placeholders, other words
are lower-cased and stripped of punctuation.  Windows of canonical words of the documents
are joined by hash with those of the benchmark items.  The placeholders' values are the
slots of a window; along one alignment of item and document every item value must always
meet the same document value (7 for 5 throughout), else the match is chance.  An item is
found in a document when consistent alignments cover enough of its windows.

Before the join a bitmap of the items' window hashes drops document windows that match no
item.  It has 2^log_bits bits whatever the benchmark's size (1 MB as set), is built from at
most that many distinct positions, and can only let too much through.  Items with the same
windows are one template, reported under its smallest id.

Edge cases: null and empty texts hold and are no items; items shorter than a window are
compared whole, items of fewer than `min_words` words are not used; a null document id is
reported as null; repeated rows are judged alike and reported once; an empty table on
either side gives an empty table; only ids and texts are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import Ids, bitmap, raw, read, slices, texts
from cutline.llm.windows import Roller, inside, mix

# Words read as numbers and as units.
NUMBER_WORDS = set("""
one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
million billion half twice dozen
""".split())
UNITS = set("""
mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet
yard yards mile miles lb lbs oz mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l
liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days
week weeks month months year years cent cents dollar dollars euro euros percent mph kmh degree degrees
watt watts volt volts
""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
_GLUED = re.compile(r"([+-]?\d[\d.,]*)([a-z]{1,12})$")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”‘’«»¿¡…"
LINE = b"\x01"


def canonical(word: str, first: bool) -> list[str]:
    """Canonical words of one raw word; `first` tells that it opens a sentence or line."""
    bare = word.strip(_EDGE)
    low = bare.lower()
    if not any(c.isalnum() for c in bare):
        return []
    if _NUMBER.match(low) or low in NUMBER_WORDS:
        return ["<num>"]
    glued = _GLUED.match(low)
    if glued and glued.group(2) in UNITS:
        return ["<num>", "<unit>"]
    if low in UNITS:
        return ["<unit>"]
    if not first and len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return ["<name>"]
    return [low.strip("$%+-")]


_SLOTS = {xxhash.xxh3_64_intdigest(t.encode()) for t in ("<num>", "<name>", "<unit>")}


class Canonical:
    """Canonical hash sequences of texts, with a bounded table of raw words."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.clear()

    def clear(self):
        self.ids = Ids()
        self.ends = np.empty(0, bool)
        # per raw word, mid-sentence and at a start: two hashes, 0 for none
        self.table = np.empty((0, 2, 2), np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        ends = np.zeros(len(words), bool)
        table = np.zeros((len(words), 2, 2), np.uint64)
        for k, w in enumerate(words):
            if w == LINE:
                ends[k] = True
                continue
            text = w.decode("utf-8", "replace")
            ends[k] = text.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
            for first in (0, 1):
                for j, t in enumerate(canonical(text, bool(first))):
                    table[k, first, j] = xxhash.xxh3_64_intdigest(t.encode()) or 1
        self.ends = np.concatenate([self.ends, ends])
        self.table = np.concatenate([self.table, table])

    def of(self, rows: list[bytes]):
        """(raw words of all texts, index of the raw word per canonical word, hashes, canonical words per text)."""
        if len(self.ids) > self.limit:
            self.clear()
        known = len(self.ids)
        split = [t.replace(LINE, b" ").replace(b"\n", b" \x01 ").split() for t in rows]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for ws in split for w in ws]
        at = self.ids.of(words)
        if len(self.ids) > known:
            self._learn(self.ids.order[known:])
        first = np.ones(len(at), bool)
        first[1:] = self.ends[at[:-1]]
        starts = (np.cumsum(lens) - lens)[lens > 0]
        first[starts] = True
        pairs = self.table[at, first.astype(np.int64)]
        flat = pairs.ravel()
        real = np.flatnonzero(flat)
        word = real >> 1
        end = np.cumsum(lens)
        count = np.diff(np.searchsorted(word, end), prepend=0) if len(end) else end
        return words, word, flat[real], count


_ROLL = 0x2545F4914F6CDD1D


def _windows(part, reader: Canonical, sizes: list[int], only=None):
    """(row, window hash, position, words in window, slot values) of a slice's windows."""
    data = raw(part, "text")
    words, word, values, count = reader.of(data)
    slot = np.isin(values, np.fromiter(_SLOTS, np.uint64))
    before = np.concatenate([[0], np.cumsum(slot)])
    first = np.cumsum(count) - count
    for size in sizes:
        if size not in _ROLLERS:
            _ROLLERS[size] = Roller(_ROLL)
        row, at = inside(count, size)
        if not len(at):
            continue
        h = mix(_ROLLERS[size].windows(values, size)[at] + np.uint64(size))
        if only is not None:
            hit = np.flatnonzero(only(h, row, size, count))
            row, at, h = row[hit], at[hit], h[hit]
        for r, a, x in zip(row.tolist(), at.tolist(), h.view(np.int64).tolist()):
            held = []
            if before[a + size] > before[a]:
                held = [words[word[k]].decode("utf-8", "replace").strip(_EDGE) for k in range(a, a + size) if slot[k]]
            yield r, x, a - int(first[r]), size, held, int(count[r]), data[r]


_ROLLERS: dict[int, Roller] = {}
_SIGNED = 1 << 63


def _key(data: bytes) -> int:
    """Spark's xxhash64 of the text, which with the id names a row."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - 2 * _SIGNED if h >= _SIGNED else h


def item_windows(items: DataFrame, window: int = 8, min_words: int = 5, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """(item_id, h, pos, size, slots, n_windows): windows of every distinct template."""

    def run(batches):
        reader = Canonical()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                def whole(h, row, size, count):
                    n = count[row]
                    return (n >= window if size == window else n == size) & (n >= min_words)
                rows = [
                    {"item_id": ids[r], "h": h, "pos": p, "size": size, "slots": held,
                     "n_windows": max(1, n - window + 1)}
                    for r, h, p, size, held, n, _ in _windows(part, reader, list(range(min(min_words, window), window + 1)), whole)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("item_id", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()),
                        ("slots", pa.list_(pa.string())), ("n_windows", pa.int32())])
    found = texts(items, id_col, text_col).mapInArrow(
        run, "item_id long, h long, pos int, size int, slots array<string>, n_windows int")
    template = found.groupBy("item_id").agg(
        F.xxhash64(F.sort_array(F.collect_set(F.struct("pos", "h", "slots")))).alias("template"))
    first = template.groupBy("template").agg(F.min("item_id").alias("item_id")).select("item_id")
    return found.dropDuplicates(["item_id", "pos", "h"]).join(first, "item_id")


def leaks(docs: DataFrame, items: DataFrame, window: int = 8, min_words: int = 5, min_cover: float = 0.6,
          log_bits: int = 23, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, cover): items found in documents, with the share of their windows."""
    bench = item_windows(items, window, min_words, item_id_col, item_text_col)
    shift = 64 - log_bits
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `window` numbers
    table = docs.sparkSession.sparkContext.broadcast(
        bitmap(bench.select(F.shiftrightunsigned("h", shift).cast("int").alias("cell")), log_bits))

    def run(batches):
        packed, reader = table.value, Canonical()

        def known(h, row, size, count):
            spot = (h >> np.uint64(shift)).astype(np.int64)
            return packed[spot >> 3] >> (spot & 7).astype(np.uint8) & 1

        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                rows = [
                    {"doc_id": ids[r], "text_key": _key(data), "h": h, "at": p, "held": held}
                    for r, h, p, _, held, _, data in _windows(part, reader, sizes, known)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("h", pa.int64()), ("at", pa.int32()),
                        ("held", pa.list_(pa.string()))])
    found = texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text_key long, h long, at int, held array<string>").distinct()
    key = ["doc_id", "text_key", "item_id", "n_windows"]
    pairs = F.transform(F.arrays_zip("slots", "held"), lambda x: F.struct(x["slots"].alias("a"), x["held"].alias("b")))
    aligned = (
        found.join(bench, "h")
        .groupBy(*key, (F.col("at") - F.col("pos")).alias("offset"))
        .agg(F.collect_set("pos").alias("met"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
        .where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))))
    )
    return (
        aligned.groupBy(*key)
        .agg((F.size(F.array_distinct(F.flatten(F.collect_set("met")))) / F.col("n_windows")).alias("cover"))
        .where(F.col("cover") >= min_cover)
        .select("doc_id", "text_key", "item_id", "cover")
    )


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no item is found."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = leaks(docs, items, **options).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    c = {name: plain[f"c{k}"] for k, name in enumerate(docs.columns)}
    text_key = F.xxhash64(F.coalesce(c[text_col].cast("string"), F.lit("")))
    return plain.join(bad, c[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (text_key == bad["_bad_key"]),
                      "left_anti").toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).groupBy("doc_id", "item_id").agg(
        F.max("cover").alias("cover"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE: dict[str, str] = {}
