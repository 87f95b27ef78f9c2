"""Language-model scores by context-tree weighting (operator 8).

A byte is eight binary decisions, each with its own context tree over the `depth` bytes before
it.  A node of a tree holds how often its bit was 0 and 1 in the training texts; its
Krichevsky-Trofimov estimate is mixed with that of the deeper nodes by the weights of the
context-tree recursion: half the node's own block probability, half the product of its
children's.  With the counts of the training texts the next-bit mixture is exact.

Counting is one pass: every batch gives its byte-trigram and word counts, Spark adds them
up.  There are at most 2^24 trigrams, which bounds the tree over two bytes, what the driver holds
while it mixes, and the table that is broadcast (in practice a few megabytes).  With two bytes
scoring looks up one entry per byte; nodes below are counted and mixed in tasks, and texts get
the probabilities of their bytes from there (`context_trees`).  The query uses `DEEP` bytes.

The base score is an add-one unigram model over lower-cased words and one end per text.
The most frequent training words (a bounded number of bounded length) are looked up in a
broadcast table; the others, by then rare, are joined by shuffle.

Edge cases: null and empty texts are one end token; a null id is never held out and trains;
repeated rows count and are scored each; an empty training set gives uniform scores; an
empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import context_trees as trees
from cutline.llm.common import id_crc, raw, read, segment_sums, slices, small_batches, texts
from cutline.plans.stage import stage

END = 0xFF  # no byte of UTF-8: ends a text, and stands for what precedes one
DEPTH = 2
DEEP = 5  # of the query


def held_out(fold: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(id_crc(), F.lit(fold)) == part, F.lit(False))


def contexts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two bytes before, byte, length) over all texts, each followed by END."""
    gap = bytes([END])
    data = np.frombuffer(gap * 2 + (gap * 2).join(rows) + gap, np.uint8) if rows else np.empty(0, np.uint8)
    lens = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    # every text has a second END behind it, which is only context of the next
    end = np.cumsum(lens + 1) + 1
    keep = np.ones(max(len(data) - 2, 0), bool)
    keep[end[:-1] - 2] = False
    wide = data.astype(np.int32)
    before = (wide[:-2] << 8 | wide[1:-1])[keep]
    return before, wide[2:][keep], lens


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift of 10."""
    shift = np.zeros_like(x)
    for k in range(10):
        shift += np.log(x + k)
    y = x + 10
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def _bit_counts(by_byte: np.ndarray) -> np.ndarray:
    """(rows, 255, 2): zeros and ones at each node of the binary tree over a byte."""
    rows = len(by_byte)
    out = np.empty((rows, 255, 2))
    level = by_byte
    for bit in range(7, -1, -1):  # from the last bit up
        pairs = level.reshape(rows, 1 << bit, 2)
        out[:, (1 << bit) - 1:(1 << bit + 1) - 1] = pairs
        level = pairs.sum(axis=2)
    return out


def _block(counts: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of each node."""
    n0, n1 = counts[..., 0], counts[..., 1]
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def _next(counts: np.ndarray) -> np.ndarray:
    """The estimate that the next bit is 1."""
    return (counts[..., 1] + 0.5) / (counts.sum(axis=-1) + 1)


def _byte_logs(p_one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the 255 bit probabilities of a row."""
    rows = len(p_one)
    logs = np.zeros((rows, 1))
    for bit in range(8):
        p = p_one[:, (1 << bit) - 1:(1 << bit + 1) - 1]
        logs = (logs[:, :, None] + np.stack([np.log10(1 - p), np.log10(p)], axis=2)).reshape(rows, 2 << bit)
    return logs


def mix_tree(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each two-byte context, log10 probabilities of the next byte per row).

    `code` holds byte trigrams (oldest byte first), `count` how often each was seen.
    """
    two, back = np.unique(code >> 8, return_inverse=True)
    leaf = np.zeros((len(two), 256))
    np.add.at(leaf, (back, code & 255), count)
    # the byte just before is the low byte of the context: children of a node differ in the older one
    one, up = np.unique(two & 255, return_inverse=True)
    mid = np.zeros((len(one), 256))
    np.add.at(mid, up, leaf)

    block_mid = np.zeros((len(one), 255))
    p_leaf = np.empty((len(two), 255))
    below = np.zeros((len(one), 255))
    for a in range(0, len(two), 4096):  # in blocks: bounded memory at 65 536 contexts
        counts = _bit_counts(leaf[a:a + 4096])
        p_leaf[a:a + 4096] = _next(counts)
        np.add.at(below, up[a:a + 4096], _block(counts))
    counts = _bit_counts(mid)
    block_mid = _block(counts)
    weighted = math.log(0.5) + np.logaddexp(block_mid, below)
    stop_mid = np.exp(math.log(0.5) + block_mid - weighted)
    kt_mid = _next(counts)
    counts = _bit_counts(mid.sum(axis=0, keepdims=True))
    block_root = _block(counts)
    stop_root = np.exp(block_root - np.logaddexp(block_root, weighted.sum(axis=0, keepdims=True)))
    kt_root = _next(counts)

    def from_root(p):
        return stop_root * kt_root + (1 - stop_root) * p

    # rows: seen contexts, then seen last bytes with an unseen byte before, then neither
    table = np.empty((len(two) + len(one) + 1, 256), np.float32)
    for a in range(0, len(two), 4096):
        m = up[a:a + 4096]
        table[a:a + 4096][: len(m)] = _byte_logs(from_root(stop_mid[m] * kt_mid[m] + (1 - stop_mid[m]) * p_leaf[a:a + 4096]))
    table[len(two):-1] = _byte_logs(from_root(stop_mid * kt_mid + (1 - stop_mid) * 0.5))
    table[-1:] = _byte_logs(from_root(np.full((1, 255), 0.5)))
    row = np.full(1 << 16, len(two) + len(one), np.int32)
    row.reshape(256, 256)[:, one] = len(two) + np.arange(len(one))
    row[two] = np.arange(len(two))
    return row, table


def top_tree(code: np.ndarray, count: np.ndarray, node: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of each two-byte context, parts of the chance of 0, of 1, factor of the chance given three bytes).

    As `mix_tree`, with nodes of two bytes above deeper ones, whose log weights sum to `weight` (see `context_trees.below`).
    """
    two, back = np.unique(code >> 8, return_inverse=True)
    leaf = np.zeros((len(two), 256))
    np.add.at(leaf, (back, code & 255), count)
    one, up = np.unique(two & 255, return_inverse=True)
    mid = np.zeros((len(one), 256))
    np.add.at(mid, up, leaf)
    near = node // 255
    older_first = (near & 255) << 8 | near >> 8
    spot = np.minimum(np.searchsorted(two, older_first), max(len(two) - 1, 0))
    seen = two[spot] == older_first if len(two) else np.zeros(len(node), bool)  # contexts of held-out texts alone weigh nothing
    deep = np.zeros((len(two), 255))
    deep[spot[seen], node[seen] % 255] = weight[seen]

    half = math.log(0.5)
    below, stop_two, kt_two = np.zeros((len(one), 255)), np.empty((len(two), 255), np.float32), np.empty((len(two), 255))
    for a in range(0, len(two), 4096):
        counts = _bit_counts(leaf[a:a + 4096])
        block = _block(counts)
        weighted = half + np.logaddexp(block, deep[a:a + 4096])
        stop_two[a:a + 4096] = np.exp(half + block - weighted)
        kt_two[a:a + 4096] = _next(counts)
        np.add.at(below, up[a:a + 4096], weighted)
    counts = _bit_counts(mid)
    block, kt_one = _block(counts), _next(counts)
    weighted = half + np.logaddexp(block, below)
    stop_one = np.exp(half + block - weighted)
    counts = _bit_counts(mid.sum(axis=0, keepdims=True))
    block, kt_root = _block(counts), _next(counts)
    stop_root = np.exp(block - np.logaddexp(block, weighted.sum(axis=0, keepdims=True)))

    size = len(two) + len(one) + 1
    zeros, ones, rest = (np.empty((size, 255), np.float32) for _ in range(3))

    def put(at, s1, k1, s2, k2):
        go = (1 - stop_root) * (1 - s1)
        ones[at] = stop_root * kt_root + (1 - stop_root) * s1 * k1 + go * s2 * k2
        zeros[at] = stop_root * (1 - kt_root) + (1 - stop_root) * s1 * (1 - k1) + go * s2 * (1 - k2)
        rest[at] = go * (1 - s2)

    for a in range(0, len(two), 4096):
        m = up[a:a + 4096]
        put(slice(a, a + len(m)), stop_one[m], kt_one[m], stop_two[a:a + 4096], kt_two[a:a + 4096])
    put(slice(len(two), size - 1), stop_one, kt_one, 0.5, 0.5)
    put(slice(size - 1, size), 0.5, 0.5, 0.5, 0.5)
    row = np.full(1 << 16, size - 1, np.int32)
    row.reshape(256, 256)[:, one] = len(two) + np.arange(len(one))
    row[two] = np.arange(len(two))
    return row, zeros, ones, rest


def corpus_counts(train: DataFrame) -> DataFrame:
    """(word, code, n): word counts (code null; '' is the end of a text) and trigram counts (word null)."""

    def run(batches):
        for batch in batches:
            words: Counter = Counter()
            grams: dict = {}
            for part in slices(batch, "text"):
                rows = [t.lower() for t in raw(part, "text")]
                for t in rows:
                    words.update(t.split())
                words[b""] += len(rows)
                before, byte, _ = contexts(rows)
                code, n = np.unique(before << 8 | byte, return_counts=True)
                for c, k in zip(code.tolist(), n.tolist()):
                    grams[c] = grams.get(c, 0) + k
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, *[None] * len(grams)], pa.binary()).cast(pa.string()),
                 pa.array([*[None] * len(words), *grams], pa.int32()),
                 pa.array([*words.values(), *grams.values()], pa.int64())], names=["word", "code", "n"])

    return train.select("text").mapInArrow(run, "word string, code int, n long").groupBy("word", "code").agg(
        F.sum("n").alias("n"))


def score(docs: DataFrame, fold: int = 7, part: int = 2, frequent: int = 100_000, max_bytes: int = 64,
          id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every text.

    Training texts are those not held out.  -score / n_bytes * log2(10) is the code length
    in bits per byte, the end counted as one byte.  `depth` is the number of bytes of context, 2 to 7;
    above 2 `docs` is read more than once and the session takes small batches.
    """
    if not 2 <= depth <= 7:
        raise ValueError("the depth must be from 2 to 7")
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("held_out", held_out(fold, part))
    counts = stage(corpus_counts(rows.where(~F.col("held_out"))), "counts")
    grams = counts.where("code is not null").select("code", "n").toArrow()  # at most 2^24 rows
    words = counts.where("word is not null").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    code, times = grams["code"].to_numpy().astype(np.int64), grams["n"].to_numpy().astype(np.float64)
    top = (
        words.where(F.octet_length("word") <= max_bytes)
        .orderBy(F.desc("n"), "word").limit(frequent).collect()
    )
    frequent_words = {r.word.encode(): r.n for r in top}
    if depth == 2:
        model = spark.sparkContext.broadcast((*mix_tree(code, times), frequent_words))
    else:
        small_batches(spark)
        rows = rows.withColumn("bucket", trees.bucket(rows))
        ask = trees.asked(rows, depth)
        sums = trees.below(ask, depth, _block).toArrow()  # at most 2^24 rows
        above = spark.sparkContext.broadcast(top_tree(code, times, sums["node"].to_numpy().astype(np.int64), sums["weight"].to_numpy()))
        replies = trees.answers(ask, depth, _block, above)
        model = spark.sparkContext.broadcast(frequent_words)
    scale = math.log10(total + kinds + 1)

    def lines(part_rows, data, bits, lens, ones, key):
        out = []
        for t in data:
            tokens = t.split()
            tokens.append(b"")
            base, sure, rare = 0.0, 0, []
            for w, n in Counter(tokens).items():
                one = ones.get(w)
                if one is None:
                    rare.append({"word": w.decode("utf-8", "replace"), "tf": n})
                else:
                    base += n * one
                    sure += n
            out.append((len(tokens), sure, base, rare))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(key, key + len(data)), pa.int64()), part_rows.column(0), part_rows.column(2),
             pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.float64()), pa.array(bits, pa.float64()),
             pa.array(lens, pa.int64()),
             pa.array([o[3] for o in out], pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())])))],
            names=["key", "doc_id", "held_out", "n_tokens", "sure", "base", "score", "n_bytes", "rare"])

    def run(batches):
        row_of, table, known = model.value
        ones = {w: math.log10(n + 1) - scale for w, n in known.items()}
        flat = table.ravel()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part_rows in slices(batch, "text"):
                data = [t.lower() for t in raw(part_rows, "text")]
                before, byte, lens = contexts(data)
                bits = segment_sums(flat[row_of[before].astype(np.int64) << 8 | byte].astype(np.float64), lens)
                yield lines(part_rows, data, bits, lens, ones, key)
                key += len(data)

    def run_deep(left, right):
        ones = {w: math.log10(n + 1) - scale for w, n in model.value.items()}
        of, made = trees.looked_up(right), []
        key = left.column("bucket")[0].as_py() << 40
        for batch in left.select(["doc_id", "text", "held_out"]).to_batches():
            for part_rows in slices(batch, "text"):
                data = [t.lower() for t in raw(part_rows, "text")]
                code, lens = trees.codes(data, depth)
                made.append(lines(part_rows, data, segment_sums(of(code), lens), lens, ones, key))
                key += len(data)
        return pa.Table.from_batches(made)

    kinds_out = ("key long, doc_id long, held_out boolean, n_tokens long, sure long, base double, score double, "
                 "n_bytes long, rare array<struct<word:string,tf:long>>")
    if depth == 2:
        scored = rows.mapInArrow(run, kinds_out)
    else:
        scored = rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(run_deep, kinds_out)
    scored = stage(scored, "scored")
    rare = (
        scored.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.tf")
        .join(words, "word", "left")
        .groupBy("key").agg(
            F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more"),
            F.sum(F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1)) - F.lit(scale))).alias("rest"))
    )
    return scored.drop("rare").join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "n_bytes")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of all documents, from the six sevenths not held out."""
    return score(read(spark, sf_dir, "documents"), depth=DEEP).drop("n_bytes")


QUERIES = {"op8_lm_score": op8_lm_score}
ORACLE: dict[str, str] = {}
