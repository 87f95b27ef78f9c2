"""Quality classifier on supervised subword embeddings (operator 4).

Words, their character n-grams and neighbouring word pairs are hashed into one table of
learned vectors.  A document is the average of the vectors of all its features; a softmax
layer over two classes gives the score.  Table and layer are trained by stochastic gradient
descent in numpy.

Training takes a bounded sample of the labelled rows, chosen by a hash of the id: at most
`sample` rows, of at most `max_chars` characters each.  Bounds and model size are
parameters; the model (buckets x dim 32-bit numbers) is what is broadcast.  Everything is
scored, whole.  A word's own vector, the sum over its features, is kept in a bounded
per-process table, so that long texts cost a few array operations a word.

Edge cases: null and empty texts have no feature and get the score of the average vector
zero; a null id is not held out and not used for training; labels that are null are not
used, of several labels of an id the largest holds; without labels all scores are 0.5; an
empty table gives an empty table; only ids, texts and the label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import Ids, id_crc, raw, read, slices, texts
from cutline.llm.windows import mix

GRAMS = (3, 4)
PAIR = np.uint64(0x9E3779B97F4A7C15)
SAME = np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(fold: int = 5) -> Column:
    return F.coalesce(F.pmod(id_crc(), F.lit(fold)) == 0, F.lit(False))


class Features:
    """Hashed features of words, in a bounded table."""

    def __init__(self, buckets: int, limit: int = 300_000):
        self.buckets, self.limit = buckets, limit
        self.vectors: np.ndarray | None = None
        self.clear()

    def clear(self):
        self.ids = Ids()
        self.hash = np.empty(0, np.uint64)
        self.own: list[list[int]] = []  # buckets of each word and its n-grams
        self.sums = np.empty((0, 0), np.float32)
        self.sizes = np.empty(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        digest, b = xxhash.xxh3_64_intdigest, self.buckets
        own = []
        for w in words:
            framed = b"<" + w + b">"
            own.append([digest(framed) % b, *(
                digest(framed[k:k + n]) % b for n in GRAMS for k in range(len(framed) - n + 1) if n < len(framed))])
        self.hash = np.concatenate([self.hash, np.array([digest(w, 7) for w in words], np.uint64)])
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.sizes = np.concatenate([self.sizes, sizes])
        if self.vectors is None:
            self.own += own
        else:
            flat = np.fromiter((x for o in own for x in o), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.vectors[flat], np.cumsum(sizes) - sizes, axis=0)
            self.sums = np.concatenate([self.sums.reshape(-1, self.vectors.shape[1]), sums])

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.clear()
        known = len(self.ids)
        at = self.ids.of(words)
        if len(self.ids) > known:
            self._learn(self.ids.order[known:])
        return at

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Bucket of each word pair (k, k + 1); all pairs of a word with itself share one."""
        h = self.hash[at]
        key = np.where(at[:-1] == at[1:], SAME, mix(h[:-1] * PAIR + h[1:]))
        return (key % np.uint64(self.buckets)).astype(np.int64)


def train(rows: list[tuple[bytes, int]], buckets: int, dim: int, epochs: int, rate: float,
          seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, weights, bias) from (text, label) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    reader = Features(buckets, limit=1 << 40)
    docs = []
    for text, label in rows:
        at = reader.words(text.split())
        if not len(at):
            continue
        word, times = np.unique(at, return_counts=True)
        own = [reader.own[k] for k in word.tolist()]
        ids = np.concatenate([np.fromiter((x for o in own for x in o), np.int64), reader.pairs(at)])
        n = np.concatenate([np.repeat(times, [len(o) for o in own]), np.ones(len(at) - 1, np.int64)])
        ids, back = np.unique(ids, return_inverse=True)
        share = np.bincount(back, n).astype(np.float32)
        docs.append((ids.astype(np.int32), share / share.sum(), label))
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, label = docs[k]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            hidden = share @ vectors[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            vectors[ids] -= (lr * share)[:, None] * (weights @ p)[None, :]
            weights -= lr * np.outer(hidden, p)
            bias -= lr * p
    return vectors, weights, bias


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int, max_chars: int, fold: int,
                label_col: str) -> list[tuple[bytes, int]]:
    """The bounded training sample: labelled rows that are not held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(~held_out(fold))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        docs.where(F.char_length("text") <= max_chars)
        .join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
        .dropDuplicates(["doc_id"]).collect()
    )
    return [(r.text.encode(), r.label) for r in sorted(rows, key=lambda r: r.doc_id)]


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fold: int = 5, sample: int = 4096,
          max_chars: int = 20_000, buckets: int = 1 << 17, dim: int = 8, epochs: int = 4, rate: float = 2.0,
          threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    rows = texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(
        train(sample_rows(rows, labels, sample, max_chars, fold, label_col), buckets, dim, epochs, rate))

    def run(batches):
        vectors, weights, bias = model.value
        reader = Features(buckets)
        reader.vectors = vectors
        for batch in batches:
            for part in slices(batch, "text"):
                split = [t.split() for t in raw(part, "text")]
                lens = np.fromiter(map(len, split), np.int64, len(split))
                at = reader.words([w for ws in split for w in ws])
                pair = reader.pairs(at)
                end = np.cumsum(lens)
                hidden = np.zeros((len(split), vectors.shape[1]))
                for k, (b, a) in enumerate(zip(end.tolist(), (end - lens).tolist())):
                    if a < b:
                        total = reader.sums[at[a:b]].sum(axis=0, dtype=np.float64)
                        total += vectors[pair[a:b - 1]].sum(axis=0, dtype=np.float64)
                        hidden[k] = total / (reader.sizes[at[a:b]].sum() + b - a - 1)
                z = hidden @ weights + bias
                p = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(p, pa.float64()),
                     pa.array((p >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", held_out(fold)).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four fifths of the labels."""
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE: dict[str, str] = {}
