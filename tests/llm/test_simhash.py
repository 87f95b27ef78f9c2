"""Fingerprints and groups against brute force."""

import random
import re

import xxhash

from cutline.llm import simhash as sh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = WORD.findall(low)
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    todo = sorted(root)
    for k, a in enumerate(todo):
        for b in todo[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in todo}


ODD = ["", None, "one", "One two", "ONE  two\nthree", "É été ÉTÉ x", "a b " * 20_000, " \x1f x\x85y z w"]


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(-1 - k, t) for k, t in enumerate(ODD)] + [(None, rows[0][1]), (None, "only null"), rows[1]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    prints = {r: plain_print(r[1] or "") for r in rows}
    groups = plain_groups(set(prints.values()))
    low = {}
    for (i, _), p in prints.items():
        if i is not None:
            low[groups[p]] = min(low.get(groups[p], i), i)
    want = sorted(((i, f"{prints[i, t]:016x}", low.get(groups[prints[i, t]])) for i, t in rows), key=str)
    for small in (64, 1):
        got = sorted((tuple(r) for r in sh.near_duplicates(frame, small=small).collect()), key=str)
        assert got == want
    left = sh.keep_one(frame)
    assert left.columns == frame.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert len(kept) == len(set(groups.values()))
    assert len({groups[prints[r]] for r in kept}) == len(kept)
    assert all(i == low.get(groups[prints[i, t]]) for i, t in kept)


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randrange(7)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {}
    for p, g in plain_groups(prints).items():
        want.setdefault(g, set()).add(p)
    for small in (64, 5, 1):
        edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in sh.links(frame, small=small).collect()]
        assert all((u ^ v).bit_count() <= 2 for u, v in edges)
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            root[find(u)] = find(v)
        got = {}
        for p in prints:
            got.setdefault(find(p), set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chains_and_empty_table(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in sh.components(path).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
