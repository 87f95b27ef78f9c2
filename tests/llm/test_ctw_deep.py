"""Scores of context trees deeper than two bytes against a bit-by-bit tree in plain Python."""

import math

import pytest
from cutline.llm import context_trees, ctw
from test_ctw import Tree, held


class Deep(Tree):
    """The recursion at any depth; contexts are the bytes before, nearest first."""

    def __init__(self, rows, depth):
        self.depth, self.n, self.children, self.block = depth, {}, {}, {}
        for t in rows:
            for path, c in self.walk(t):
                node = 1
                for k in range(7, -1, -1):
                    bit = c >> k & 1
                    for d in range(depth + 1):
                        self.n.setdefault((node, path[:d]), [0, 0])[bit] += 1
                    node = node * 2 + bit
        for node, context in self.n:
            if context:
                self.children.setdefault((node, context[:-1]), []).append(context)

    def walk(self, t):
        data = [255] * self.depth + [*t, 255]
        return [(tuple(data[i - 1 - j] for j in range(self.depth)), data[i]) for i in range(self.depth, len(data))]

    def pw(self, node, context):
        key = node, context
        if key not in self.block:
            own = self.pe(key)
            if len(context) < self.depth:
                deep = sum(self.pw(node, c) for c in self.children.get(key, ()))
                top = max(own, deep)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(deep - top))
            self.block[key] = own
        return self.block[key]

    def p_one(self, node, path, d=0):
        a, b = self.n.get((node, path[:d]), (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        stop = math.exp(math.log(0.5) + self.pe((node, path[:d])) - self.pw(node, path[:d]))
        return stop * kt + (1 - stop) * self.p_one(node, path, d + 1)

    def score(self, t):
        out = 0.0
        for path, c in self.walk(t):
            node = 1
            for k in range(7, -1, -1):
                bit, p = c >> k & 1, self.p_one(node, path)
                out += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        return out


@pytest.mark.parametrize("depth", [3, 5, 7])
def test_deep_trees(spark, monkeypatch, depth):
    """Texts in several buckets: held-out ones, unseen contexts, empty, null and repeated rows."""
    monkeypatch.setattr(context_trees, "BUCKET", 3000)
    rows = [(r.doc_id, r.text[:700]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    rows += [(1001, ""), (1002, None), (None, "no id At all"), rows[3], (1003, "é" * 50), (1004, "a" * 300), (1005, "new\x0bwords ÉÀ")]
    low = [(i, (t or "").encode().lower()) for i, t in rows]
    tree = Deep([t for i, t in low if not held(i)], depth)
    assert any(held(i) for i, _ in rows)
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()
    plain = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.n_bytes)) for r in got) == sorted(
        str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.n_bytes)) for r in plain)
    for i, t in low:
        assert any(math.isclose(r.score, tree.score(t), rel_tol=1e-4, abs_tol=1e-4) for r in got if r.doc_id == i), (i, t)


def test_nothing_to_learn_from_in_depth(spark):
    only = next(k for k in range(100) if held(k))
    frame = spark.createDataFrame([(only, "abc")], "doc_id long, text string")
    assert math.isclose(ctw.score(frame, depth=5).first().score, -8 * 4 * math.log10(2), rel_tol=1e-6)
    assert ctw.score(frame.limit(0), depth=5).collect() == []


def test_the_query_uses_more_than_two_bytes(spark):
    """Held-out texts are better foreseen than by two bytes."""
    path = "/root/testdata/sf0.01"
    two = ctw.score(spark.read.parquet(f"{path}/documents.parquet")).where("held_out").agg({"score": "sum"}).first()[0]
    assert ctw.op8_lm_score(spark, path).where("held_out").agg({"score": "sum"}).first()[0] > 0.9 * two
