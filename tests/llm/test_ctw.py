"""Scores against a bit-by-bit tree in plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from cutline.llm import ctw

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Tree:
    """Context trees of depth two, one per node of the byte's binary tree, by the recursion."""

    def __init__(self, rows):
        self.n = {}
        for t in rows:
            for a, b, c in self.steps(t):
                node = 1
                for k in range(7, -1, -1):
                    bit = c >> k & 1
                    for context in ((), (b,), (b, a)):
                        self.n.setdefault((node, context), [0, 0])[bit] += 1
                    node = node * 2 + bit
        self.children = {}
        for node, context in self.n:
            if context:
                self.children.setdefault((node, context[:-1]), []).append(context)
        self.block = {}

    @staticmethod
    def steps(t):
        data = [255, 255, *t, 255]
        return zip(data, data[1:], data[2:])

    def pe(self, key):
        a, b = self.n.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(self, node, context):
        key = node, context
        if key not in self.block:
            own = self.pe(key)
            if len(context) < 2:
                deep = sum(self.pw(node, c) for c in self.children.get(key, ()))
                own = math.log(0.5) + np.logaddexp(own, deep)
            self.block[key] = own
        return self.block[key]

    def p_one(self, node, path, depth=0):
        key = node, path[:depth]
        a, b = self.n.get(key, (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if depth == 2:
            return kt
        stop = math.exp(math.log(0.5) + self.pe(key) - self.pw(*key))
        return stop * kt + (1 - stop) * self.p_one(node, path, depth + 1)

    def score(self, t):
        out = 0.0
        for a, b, c in self.steps(t):
            node = 1
            for k in range(7, -1, -1):
                bit, p = c >> k & 1, self.p_one(node, (b, a))
                out += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, key int, word string")
    got = ctw.score(frame, **options).collect()
    low = [(i, (t or "").encode().lower()) for i, t in rows]
    counts = Counter()
    for i, t in low:
        if not held(i):
            counts.update([*WORD.findall(t), b""])
    total, kinds = sum(counts.values()), len(counts)
    tree = Tree([t for i, t in low if not held(i)])
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t in low:
        tokens = [*WORD.findall(t), b""]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        want = tree.score(t)
        assert any(
            r.held_out == held(i) and r.n_tokens == len(tokens) and r.n_known == sum(counts[w] > 0 for w in tokens)
            and r.train_tokens == total and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
            and math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-4) and r.n_bytes == len(t) + 1
            for r in by_id[i])


def test_documents(spark):
    rows = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rows += [(1001, ""), (1002, None), (None, "no id At all"), rows[3], (1003, "é" * 300), (1004, "a" * 500), (1005, "new\x0bwords ÉÀ")]
    check(spark, rows)
    check(spark, rows, frequent=5)


def test_nothing_to_learn_from(spark):
    only = next(k for k in range(100) if held(k))
    frame = spark.createDataFrame([(only, "abc")], "doc_id long, text string")
    row = ctw.score(frame).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)
    assert math.isclose(row.score, -8 * 4 * math.log10(2), rel_tol=1e-6)
    assert ctw.score(frame.limit(0)).collect() == []


def test_scores_tell_text_from_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = ctw.score(docs.select("doc_id", "text")).where("held_out and n_bytes > 200").selectExpr("-score / n_bytes * log2(10) as bits").toPandas()
    assert 0 < out.bits.mean() < 4


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1000.5, 1e8])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
