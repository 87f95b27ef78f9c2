"""Runs against the definition, read off every period of every text."""

import hashlib
import random
import zlib

import numpy as np

from cutline.llm import periods as P


def plain_runs(words, least=12):
    """Smallest periods and maximality tested on every stretch, straight from the definition."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, 2 * q) and (s, e) not in seen:
                seen.add((s, e))
                out.append((s, e, q))
            s = e - q + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted):
    words = (text or "").encode().split()
    n = len(words)
    if planted and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(runs), *top,
            hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def check(spark, rows, planted):
    frame = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, length double")
    got = sorted((tuple(r) for r in P.digests(frame, planted=planted).collect()), key=repr)
    assert got == sorted((plain_row(i, t, planted) for i, t in rows), key=repr)
    return got


def test_documents_and_edge_cases(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1] or "") < 30_000]
    rows += [(-1, None), (-2, ""), (None, "a b " * 9), (-3, "x " * 3000), (-4, "x " * 11), (-5, "x " * 12), rows[0],
             (-6, "a b c a b c d " * 3 + "a b c"), (-7, " \n\t "), (-8, "é ü " * 20), (-9, "one two"), (-10, "w")]
    got = check(spark, rows, True)
    assert sum(r[1] > 0 for r in got) > 15
    check(spark, rows, False)


def texts_of(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(120))]
    if kind == 1:
        unit = [rng.randrange(9) for _ in range(rng.randrange(1, 30))]
        around = [rng.randrange(9) for _ in range(rng.randrange(20))]
        return around + unit * rng.randrange(1, 6) + unit[:rng.randrange(len(unit))] + around[::-1]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < rng.randrange(10, 200):
            a, b = b, b + a
        return b
    if kind == 3:
        return list(range(rng.randrange(60))) * rng.randrange(1, 5)
    if kind == 4:
        unit = [rng.randrange(3) for _ in range(7)]
        return (unit + unit + [5] + unit) * rng.randrange(1, 5) + [7] + unit * 3
    return [bin(i).count("1") & 1 for i in range(rng.randrange(300))]


def test_random_word_sequences():
    rng = random.Random(1)
    for _ in range(250):
        docs = [texts_of(rng) for _ in range(rng.randrange(1, 6))]
        lens = np.array([len(d) for d in docs], np.int64)
        own = np.array([k * 1000 + w for k, d in enumerate(docs) for w in d], np.int64)
        got = P.runs_of(own, lens)
        assert got == [plain_runs(d) for d in docs]
        assert got == [P.brute_force(np.array(d, np.int64)) for d in docs]


def test_long_texts_and_small_blocks(monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 64)
    rng = random.Random(2)
    docs = [[1] * 5000, list(range(10)) * 300, [rng.randrange(50) for _ in range(3000)] * 2]
    lens = np.array([len(d) for d in docs], np.int64)
    own = np.array([k * 1000 + w for k, d in enumerate(docs) for w in d], np.int64)
    assert P.runs_of(own, lens) == [P.brute_force(np.array(d, np.int64)) for d in docs]


def test_a_wrong_hash_is_found(monkeypatch):
    """With hashes that claim too much the comparison word by word still gives the runs."""
    monkeypatch.setattr(P.Matches, "equal", lambda self, x, y, size: np.ones(len(x), bool))
    words = np.array([9, 8] + [1, 2, 3] * 6 + [4, 5], np.int64)
    assert P.runs_of(words, np.array([len(words)])) == [[(2, 20, 3)]]


def test_collapse(spark):
    frame = spark.createDataFrame([(1, "a " + "b c " * 8 + "d"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in P.collapse(frame).collect()} == {(1, 1, "a b c d"), (2, 0, "")}


def test_empty_table(spark):
    assert P.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
