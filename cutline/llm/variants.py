"""Spelling variants: words one edit apart, by k-d trees over letter counts (operator 11).

1. Words.  Runs of letters are counted with map-side sums; only words that can matter (long
   enough, often enough) are kept.
2. Vectors.  A word is the vector of its letter counts.  One inserted or deleted letter changes
   one count by one, one replaced letter two counts by one: near words of equal length are
   at L1 distance at most 2, those of lengths n and n + 1 at most 1.  Letters outside a-z share
   six counts, which can only make distances smaller.
3. Cells.  A k-d tree over the vectors of a bounded sample (`SAMPLE` words of each length) cuts
   the words of each length into cells; the sample decides sizes only, all words are placed.
   A word goes as a point to its own cell and as a query to every cell, of its length and the
   lengths beside it, whose box is near enough: with d cuts about d^2 / 2 of the 2^d cells.
4. Search.  In a cell the points form a k-d tree with leaves of `LEAF` words, the queries
   another; pairs of leaves whose boxes are too far apart are pruned.  In the others
   vectors are compared as bits in unary, whose differing bits are the L1 distance (counts
   over four are cut, so again it can only be smaller), and what is near enough is verified
   letter by letter.  A leaf's partners are worked on in blocks of bounded size.
5. Forms.  Each word keeps the number of its near words and the most frequent of them (ties:
   smallest in code-point order).  It is the word's form if it is `ratio` times as frequent.
   Following forms multiplies the count by `ratio`, so chains are short: pointers are doubled
   until they reach the last form of any chain that the total count allows.

Edge cases: a null or empty text has no words; a null id changes no word; repeated rows count
each time; an empty table gives an empty table; only the id and the text are read, so extra
columns and clashing names do no harm.  A very long text is split by the JVM as one row; a
word of any length is handled (words are laid out length by length).  Words of one vector
(anagrams) cannot be cut apart and share a leaf; they meet in blocks, never in one matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import crc32_sql, read, texts
from cutline.plans.stage import stage

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIMS = 32
SAMPLE = 1 << 14
CELL = 1 << 16
LEAF = 128
BLOCK = 1 << 18
RATIO = 10


def words_of(docs: DataFrame, least_length: int = 7, least_count: int = 2, drop_every: int | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters with their number.

    With `drop_every` a run whose crc32 with its id is divisible loses one letter, as the query asks.
    """
    # shorter runs make no word, so the pattern skips them; a longer run is matched whole
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    rows = texts(docs, id_col, text_col).select("doc_id", F.explode(runs).alias("run"))
    rows = rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if drop_every:
        key = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
        rows = rows.select("word", F.when(key % drop_every == 0, key).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(F.col("h").isNull(), F.col("word")).otherwise(cut).alias("word"))
        rows = rows.where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths): one row a word, padded with 0."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(lens.max(initial=0)) + 1), np.uint32)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat
    return out, lens


def vectors(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Letter counts, at most 255 each."""
    dim = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % 6).astype(np.int64)
    real = np.arange(codes.shape[1]) < lens[:, None]
    cell = (np.arange(len(codes))[:, None] * DIMS + dim)[real]
    return np.minimum(np.bincount(cell, minlength=len(codes) * DIMS).reshape(len(codes), DIMS), 255).astype(np.uint8)


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, threshold) that divides the points best: left has counts below the threshold."""
    best, at = 0, None
    low, high = points.min(axis=0), points.max(axis=0)
    for d in np.flatnonzero(high > low):
        below = np.cumsum(np.bincount(points[:, d]))[:-1]
        part = np.minimum(below, len(points) - below)
        t = int(part.argmax())
        if part[t] > best:
            best, at = int(part[t]), (int(d), t + 1)
    return at


def top_tree(points: np.ndarray, depth: int) -> list:
    """Nodes (dimension, threshold, left, right); a leaf is (-1, cell, 0, 0)."""
    nodes: list = []
    cells = 0

    def grow(part: np.ndarray, depth: int) -> int:
        nonlocal cells
        me = len(nodes)
        nodes.append(None)
        at = _cut(part) if depth and len(part) > 1 else None
        if at is None:
            nodes[me] = (-1, cells, 0, 0)
            cells += 1
        else:
            left = part[:, at[0]] < at[1]
            nodes[me] = (*at, grow(part[left], depth - 1), grow(part[~left], depth - 1))
        return me

    grow(points, depth)
    return nodes


def reached(nodes: list, points: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, int]]:
    """(indexes of points, cell) of every cell whose box lies within L1 distance `budget`.

    The distance to a box is the sum over the dimensions that lie outside it; counts that were cut
    several times along one dimension are charged once, by the farthest threshold.
    """
    stack = [(0, np.arange(len(points)), np.zeros((len(points), 0), np.int16), ())]
    while stack:
        node, who, cost, dims = stack.pop()
        d, t, left, right = nodes[node]
        if d < 0:
            yield who, t
            continue
        value = points[who, d].astype(np.int16)
        for child, out in ((left, np.maximum(value - t + 1, 0)), (right, np.maximum(t - value, 0))):
            if d in dims:
                k = dims.index(d)
                paid, known = cost.copy(), dims
                paid[:, k] = np.maximum(paid[:, k], out)
            else:
                paid, known = np.concatenate([cost, out[:, None]], axis=1), (*dims, d)
            keep = paid.sum(axis=1) <= budget
            if keep.any():
                stack.append((child, who[keep], paid[keep], known))


def budget_of(length: int, other: int) -> int:
    return 2 if length == other else 1


def leaves(points: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): indexes of points leaf by leaf, and where each leaf begins (and the end)."""
    order, starts, stack = [], [0], [np.arange(len(points))]
    while stack:
        who = stack.pop()
        at = _cut(points[who]) if len(who) > size else None
        if at is None:
            order.append(who)
            starts.append(starts[-1] + len(who))
        else:
            left = points[who, at[0]] < at[1]
            stack += [who[~left], who[left]]
    return np.concatenate(order), np.array(starts)


def _unary(points: np.ndarray) -> np.ndarray:
    """Counts as bits, four for each letter: differing bits are the L1 distance of counts up to four."""
    bits = points[:, :, None] > np.arange(4)
    return np.packbits(bits.reshape(len(points), -1), axis=1).view(np.uint64)


def one_edit(a: np.ndarray, b: np.ndarray, shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Is b[k] one edit from a[k]?  Rows of padded code points; lengths are equal or differ by one."""
    width = min(a.shape[1], b.shape[1])
    differ = a[:, :width] != b[:, :width]
    if (shorter == longer).all():
        return differ.sum(axis=1) == 1
    first = differ.argmax(axis=1)  # the padding differs at the latest
    k = np.arange(width)
    tail = b[:, 1:width + 1] if b.shape[1] > width else np.pad(b[:, 1:width], ((0, 0), (0, 1)))
    return ~((a[:, :width] != tail) & (k >= first[:, None]) & (k < shorter[:, None])).any(axis=1)


def near_in_cell(queries: list[str], points: list[str], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) indexes of pairs one edit apart.  All queries have one length, all points one."""
    qc, ql = _codes(queries)
    pc, pl = _codes(points)
    qv, pv = vectors(qc, ql), vectors(pc, pl)
    qo, qs = leaves(qv)
    po, ps = leaves(pv)
    qc, qv, qb = qc[qo], qv[qo].astype(np.int16), _unary(qv[qo])
    pc, pv, pb = pc[po], pv[po].astype(np.int16), _unary(pv[po])
    low, high = np.minimum.reduceat(pv, ps[:-1]), np.maximum.reduceat(pv, ps[:-1])
    size = np.diff(ps)
    for a, b in zip(qs[:-1].tolist(), qs[1:].tolist()):
        lo, hi = qv[a:b].min(axis=0), qv[a:b].max(axis=0)
        gap = (np.maximum(low - hi, 0) + np.maximum(lo - high, 0)).sum(axis=1)
        near = np.flatnonzero(gap <= budget)
        if not len(near):
            continue
        reach = np.concatenate([np.arange(ps[k], ps[k] + size[k]) for k in near])
        rows = max(1, BLOCK // len(reach))
        for q in range(a, b, rows):
            mine = np.arange(q, min(b, q + rows))
            for r in range(0, len(reach), BLOCK):
                theirs = reach[r:r + BLOCK]
                dist = np.bitwise_count(qb[mine, 0][:, None] ^ pb[theirs, 0])
                for k in range(1, qb.shape[1]):
                    dist += np.bitwise_count(qb[mine, k][:, None] ^ pb[theirs, k])
                # one flat index a hit: numpy finds places in one dimension several times faster than in two
                i, j = divmod(np.flatnonzero(dist <= budget), len(theirs))
                i, j = mine[i], theirs[j]
                flip = ql[0] > pl[0]
                x, y = (pc[j], qc[i]) if flip else (qc[i], pc[j])
                short = np.full(len(i), min(ql[0], pl[0]))
                ok = one_edit(x, y, short, np.full(len(i), max(ql[0], pl[0])))
                if ok.any():
                    yield qo[i[ok]], po[j[ok]]


def _trees(words: DataFrame, sample: int, cell: int) -> dict[int, list]:
    """A k-d tree for each length, from `sample` words of it at most, deep enough for cells of about `cell`."""
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    big = {k: v for k, v in sizes.items() if v > cell}
    trees = {k: [(-1, 0, 0, 0)] for k in sizes}
    if big:
        share = F.create_map(*[F.lit(x) for k, v in big.items() for x in (k, min(1.0, sample / v) * 0.9)])
        place = (F.xxhash64("word").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40))
        part = words.where(F.length("word").isin(list(big)) & (place < share[F.length("word")])).select("word").toPandas()
        by: dict[int, list] = {}
        for w in sorted(part["word"]):
            by.setdefault(len(w), []).append(w)
        for k, ws in by.items():
            trees[k] = top_tree(vectors(*_codes(ws)), math.ceil(math.log2(big[k] / cell)))
    return trees


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n_near, top): the number of near words, and the most frequent as (-n, word), of `words` (word, n)."""
    spark = words.sparkSession
    trees = spark.sparkContext.broadcast(_trees(words, sample, cell))

    def place(batches):
        tree = trees.value
        for batch in batches:
            text, count = batch.column(0).to_pylist(), batch.column(1)
            lens = np.fromiter(map(len, text), np.int64, len(text))
            for length in np.unique(lens).tolist():
                mine = np.flatnonzero(lens == length)
                vec = vectors(*_codes([text[k] for k in mine]))
                jobs = [(length, 0, False)] + [(o, budget_of(length, o), True) for o in (length - 1, length, length + 1) if o in tree]
                for other, budget, query in jobs:
                    for who, at in reached(tree[other], vec, budget):
                        take = pa.array(mine[who])
                        m = len(who)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, other, np.int32)), pa.array(np.full(m, at, np.int32)),
                             pa.array(np.full(m, query)), batch.column(0).take(take), count.take(take)],
                            names=["length", "cell", "query", "word", "n"])

    def search(key, table):
        text = np.array(table.column("word").to_pylist(), object)
        n = table.column("n").to_numpy().astype(np.int64)
        asks = table.column("query").to_numpy().astype(bool)
        points = np.flatnonzero(~asks)
        order = np.array(sorted(points.tolist(), key=lambda k: (-n[k], text[k])), np.int64)
        lens = np.fromiter(map(len, text), np.int64, len(text))
        total = np.zeros(len(text), np.int64)
        best = np.full(len(text), len(order), np.int64)
        for length in np.unique(lens[asks]).tolist() if len(order) else ():
            mine = np.flatnonzero(asks & (lens == length))
            for q, p in near_in_cell(text[mine].tolist(), text[order].tolist(), budget_of(length, key[0].as_py())):
                total += np.bincount(mine[q], minlength=len(text))
                np.minimum.at(best, mine[q], p)
        hit = np.flatnonzero(total)
        top = order[best[hit]] if len(hit) else hit
        return pa.table({"word": pa.array(text[hit], pa.string()), "n_near": pa.array(total[hit]),
                         "less": pa.array(-n[top]), "top": pa.array(text[top], pa.string())})

    placed = words.select("word", F.col("n").cast("long")).mapInArrow(
        place, "length int, cell int, query boolean, word string, n long")
    found = placed.groupBy("length", "cell").applyInArrow(search, "word string, n_near long, less long, top string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "top")).alias("top"))


def forms(words: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `words` (word, n)."""
    words = stage(words, "words")
    near = near_words(words, sample, cell).select(
        "word", "n_near", F.col("top.top").alias("other"), (-F.col("top.less")).alias("other_n"))
    good = F.col("other_n") >= ratio * F.col("n")
    table = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(good, F.col("other")).alias("form"), F.when(good, F.col("other_n")).alias("form_n")), "forms")
    jump = table.where("form is not null").select("word", F.col("form").alias("root"))
    largest = table.agg(F.max("n")).first()[0] or 1
    chain = math.log(largest, ratio) + 1
    for _ in range(math.ceil(math.log2(chain + 1))):
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jump = stage(jump.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return table.join(jump, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of seven letters or more."""
    return forms(words_of(read(spark, sf_dir, "documents"), drop_every=31))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
#: Near words by equal patterns: a word with one letter masked, or with one letter less.
ORACLE = {"op11_spelling_variants": f"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times FROM lowered WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {crc32_sql("(CAST(doc_id AS VARCHAR) || ':' || run)")} AS h FROM counted),
cut AS (SELECT times, CASE WHEN h % 31 = 0
    THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut GROUP BY word HAVING length(word) >= 7 AND sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
masked AS (SELECT word, n, substr(word, 1, CAST(k - 1 AS INTEGER)) || '*' || substr(word, CAST(k + 1 AS INTEGER)) AS p FROM places),
less AS (SELECT DISTINCT word, n, substr(word, 1, CAST(k - 1 AS INTEGER)) || substr(word, CAST(k + 1 AS INTEGER)) AS p FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM masked a JOIN masked b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.p = w.word
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.p = w.word),
near AS (SELECT word, count(DISTINCT other) AS n_near, arg_min(other, (-n, other)) AS top, max(n) AS top_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {RATIO} * w.n THEN top END AS form,
    CASE WHEN top_n >= {RATIO} * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS at, form AS ahead FROM formed
  UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON k.ahead = f.word)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.ahead IS NULL"""}
