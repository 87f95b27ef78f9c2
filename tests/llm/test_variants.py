"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cutline.llm import variants as V


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_words(rows, drop_every=31):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None and drop_every:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % drop_every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain_forms(words):
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    partners = {w: [v for k in (-1, 0, 1) for v in by.get(len(w) + k, ()) if v != w and near(w, v)] for w in words}
    form = {}
    for w, vs in partners.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(partners[w]), words.get(form[w])))
    return sorted(rows, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def made(seed, size):
    rng = random.Random(seed)
    words = Counter()
    stems = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randrange(7, 11))) for _ in range(size // 4)]
    for _ in range(size):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], [w[k], rng.choice("abcé")], [rng.choice("abcdeñ")]])
        if len(w) >= 7:
            words["".join(w)] += rng.choice([2, 3, 40, 900])
    words["a" * 300], words["a" * 301], words["a" * 299 + "b"], words["b" + "a" * 299] = 5, 60, 7, 9
    return dict(words)


@pytest.mark.parametrize("cell, leaf, block", [(1 << 16, 128, 1 << 18), (40, 4, 16)])
def test_made_words(spark, monkeypatch, cell, leaf, block):
    monkeypatch.setattr(V, "BLOCK", block)
    words = made(1, 1500)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert rows_of(V.forms(frame, cell=cell)) == plain_forms(words)


def test_cells_hold_every_near_word():
    """Words are placed in the cell of every word one edit away, whatever the cuts."""
    words = sorted(made(2, 2500))
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for length in (7, 8, 9):
        other = by[length]
        tree = V.top_tree(V.vectors(*V._codes(other)), 6)
        own = {other[k]: cell for who, cell in V.reached(tree, V.vectors(*V._codes(other)), 0) for k in who}
        assert len(own) == len(other) and len(set(own.values())) > 20
        for asks in (length - 1, length, length + 1):
            if asks not in by:
                continue
            at = {}
            for who, cell in V.reached(tree, V.vectors(*V._codes(by[asks])), V.budget_of(asks, length)):
                for k in who:
                    assert cell not in at.setdefault(by[asks][k], set())
                    at[by[asks][k]].add(cell)
            for w in by[asks][:150]:
                assert all(own[v] in at[w] for v in other if near(w, v))


def test_documents_and_edge_cases(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (None, "Préfixe préfixe PRÉFIXE préfixe"), (-3, "Abcdefgh " * 500), (-4, "abcdefg " * 3), rows[0]]
    frame = spark.createDataFrame([(a, b, 3) for a, b in rows], "doc_id long, text string, n int")
    assert rows_of(V.forms(V.words_of(frame, drop_every=31))) == plain_forms(plain_words(rows))


def test_chains_reach_their_last_form(spark):
    words = {"aaaaaaa" + "b" * k + "c" * (9 - k): 3 * 10 ** (k + 1) for k in range(10)}
    got = {r.word: r.root for r in V.forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaaabbbbbbbbb"}


def test_empty_table(spark):
    assert V.forms(V.words_of(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_one_edit():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))
        b = "".join(rng.choice("ab") for _ in range(len(a) + rng.randrange(2)))
        x, y = V._codes([a])[0], V._codes([b])[0]
        ok = V.one_edit(x, y, np.array([len(a)]), np.array([len(b)]))
        assert bool(ok[0]) == (near(a, b) and a != b)
