"""Substring deduplication with a count-min prefilter (operator 5).

A window is `width` consecutive words.  A word goes if it lies in a window whose words also
start a window of a document with a smaller id.

0. Exact copies.  A document with the text of one of a smaller id loses everything if it
   has a window at all, so it takes no part in what follows.  Copies are found by a
   128-bit text hash: the smallest id of each text that occurs twice is joined to the
   documents, by broadcast while there are at most `COPY_TEXTS` such texts, else by a
   shuffle.
1. Sketch.  Every partition counts into a count-min sketch, stored sparsely as (cell,
   count) rows, and Spark adds the partition sketches up.  What is counted is not each
   window but its minimiser, the smallest hash among its inner `inner`-word shingles: equal
   windows have equal minimisers and consecutive windows mostly share one, so a run of
   windows with one minimiser is counted once.  The estimate of a window's minimiser is
   never below the number of its runs, hence every window that repeats across documents is
   estimated at two or more: none is lost.
2. Exact pass.  Only windows estimated repeated are given a 96-bit fingerprint and
   grouped: the smallest id per fingerprint (a minimum, combined on the map side) is joined
   back, and windows of larger ids are marked.  Neither step needs a group in one place.
3. Every document drops the words its marked windows cover.

The sketch has `depth` rows of 2^`log_width` cells at every input size.  The driver keeps
one bit per cell (is the count above one): depth * 2^log_width / 8 bytes, 32 MB as set,
which is the bound of what is broadcast.  The width is a parameter to raise with the
corpus; in a sketch that is too narrow more windows reach the exact pass, none fewer.

Edge cases: null and empty texts have no words and keep none; a null id counts as larger
than every id, so such a row loses what any document with an id has; rows that repeat an id
are one document and never remove from each other; an empty table gives an empty table;
only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import bitmap, raw, read, slices, texts
from cutline.llm.windows import Roller, WordHashes, inside, mix, sliding_min
from cutline.plans.stage import stage

WIDTH = 50
LAST = (1 << 63) - 1  # stands for a null id
COPY_TEXTS = 1 << 21


class _Windows:
    """Hashes of all windows of a slice."""

    def __init__(self, width: int, inner: int):
        self.width, self.inner = width, inner
        self.words = WordHashes()
        self.a, self.b, self.c = Roller(0x5851F42D4C957F2D), Roller(0xDA942042E4DD58B5), Roller(0xD1342543DE82EF95)

    def read(self, rows: list[bytes]):
        """(words per document, document and position of each window, word hashes)."""
        split = [t.split() for t in rows]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        values = self.words.of([w for ws in split for w in ws])
        doc, at = inside(lens, self.width)
        return split, lens, doc, at, values

    def minimisers(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        shingles = self.c.windows(values, self.inner)
        return sliding_min(shingles, self.width - self.inner + 1)[at] if len(at) else at.astype(np.uint64)

    def prints(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return at.astype(np.int64), at.astype(np.int32)
        one = self.a.windows(values, self.width)[at]
        two = self.b.windows(mix(values), self.width)[at]
        return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _cells(minimiser: np.ndarray, row: int, log_width: int) -> np.ndarray:
    """Cell numbers of one sketch row."""
    h = mix(minimiser + np.uint64(0x632BE59BD9B4E019 * (row + 1) % (1 << 64)))
    return (h >> np.uint64(64 - log_width)).astype(np.int64) + (row << log_width)


def repeated_cells(docs: DataFrame, width: int, inner: int, depth: int, log_width: int) -> np.ndarray:
    """Bits of the merged sketch whose count exceeds one (numpy bytes, little bit first)."""

    def sketch(batches):
        windows = _Windows(width, inner)
        for batch in batches:
            cells = []
            for part in slices(batch, "text"):
                _, _, doc, at, values = windows.read(raw(part, "text"))
                low = windows.minimisers(values, at)
                if len(low):
                    head = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
                    cells += [_cells(low[head], r, log_width) for r in range(depth)]
            if cells:
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["cell", "n"])

    if depth << log_width > 1 << 31:
        raise ValueError("a sketch has at most 2^31 cells")
    merged = docs.select("text").mapInArrow(sketch, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    return bitmap(merged.where("n > 1"), (depth << log_width).bit_length() - 1 + ((depth & (depth - 1)) > 0))


def with_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, text, ord, copy): is the text that of a document with a smaller id?"""
    keyed = rows.withColumns({
        "ord": F.coalesce("doc_id", F.lit(LAST)), "k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    first = stage(
        keyed.groupBy("k1", "k2").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
        .where("low < high").drop("high"), "copies")
    few = first.limit(COPY_TEXTS + 1).count() <= COPY_TEXTS
    return keyed.join(F.broadcast(first) if few else first, ["k1", "k2"], "left").select(
        "doc_id", "text", "ord", F.coalesce(F.col("low") < F.col("ord"), F.lit(False)).alias("copy"))


def drop_repeats(docs: DataFrame, width: int = WIDTH, inner: int = 30, depth: int = 2,
                 log_width: int = 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words kept, joined by one space."""
    keyed = with_copies(texts(docs, id_col, text_col))
    rows = keyed.where(~F.col("copy"))
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(repeated_cells(rows, width, inner, depth, log_width))

    def candidates(batches):
        bits = table.value
        windows = _Windows(width, inner)
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, doc, at, values = windows.read(raw(part, "text"))
                low = windows.minimisers(values, at)
                hit = np.ones(len(low), bool)
                for r in range(depth):
                    cell = _cells(low, r, log_width)
                    hit &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                doc, at = doc[hit], at[hit]
                h1, h2 = windows.prints(values, at)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(ids[doc], pa.int64())], names=["h1", "h2", "ord"])

    found = stage(rows.select("ord", "text").mapInArrow(candidates, "h1 long, h2 int, ord long"), "windows")
    # stored, so that the join reads both sides by shuffle and a crowded window is split over tasks
    first = stage(
        found.groupBy("h1", "h2").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
        .where("low < high").drop("high"), "first")
    marks = (
        found.join(first, ["h1", "h2"]).where("ord > low")
        .groupBy("ord").agg(F.collect_set("h1").alias("marks"))
    )
    both = keyed.join(marks, "ord", "left").select("doc_id", "text", "marks", "copy")

    def strip(batches):
        windows = _Windows(width, inner)
        for batch in batches:
            for part in slices(batch, "text"):
                data = raw(part, "text")
                marked, copies = part.column(2), part.column(3).to_pylist()
                words = np.zeros(len(data), np.int64)
                gone = np.zeros(len(data), np.int64)
                out = []
                for k, text in enumerate(data):
                    hits = marked[k].values
                    if copies[k]:
                        split = text.split()
                        words[k] = len(split)
                        if len(split) >= width:
                            gone[k], split = len(split), []
                    elif hits is None:
                        split = text.split()
                    else:
                        (split,), _, _, at, values = windows.read([text])
                        h1, _ = windows.prints(values, at)
                        start = at[np.isin(h1, hits.to_numpy(zero_copy_only=False))]
                        edge = np.zeros(len(split) + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + width, -1)
                        cover = np.cumsum(edge[:-1]) > 0
                        words[k], gone[k] = len(split), int(cover.sum())
                        split = [w for w, c in zip(split, cover.tolist()) if not c]
                    words[k] = max(words[k], len(split))
                    out.append(b" ".join(split))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(words), pa.array(gone)],
                    names=["doc_id", "text", "n_words", "n_removed"])

    return both.mapInArrow(strip, "doc_id long, text string, n_words long, n_removed long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words over all documents."""
    return drop_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {"op5_substring_dedup": r"""
    WITH docs AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    wins AS MATERIALIZED (
        SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs)),
    first AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win),
    hits AS MATERIALIZED (SELECT doc_id, i FROM wins JOIN first USING (win) WHERE low < doc_id),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM docs),
    marked AS (
        SELECT w.doc_id, word, p, p - max(i) OVER (PARTITION BY w.doc_id ORDER BY p) < 50 AS gone
        FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.i = w.p),
    kept AS (
        SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
               string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT coalesce(gone, false)) AS body
        FROM marked GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(body, '')) AS kept_sha256
    FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""}
