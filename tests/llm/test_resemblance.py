"""The pipeline's near-copy stage against all pairs."""

import random

import corpus_pipeline as cp
from cutline.llm import simhash as sh
from test_simhash import plain_groups, plain_print


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k:k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def plain_keep(rows):
    """[(id, text)] that stay: the smallest id of every group, ids and texts being distinct."""
    root = {r: r for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = {r: plain_print(r[1] or "") for r in rows}
    groups = plain_groups(set(prints.values()))
    sets = {r: shingles(r[1]) for r in rows}
    for k, a in enumerate(rows):
        for b in rows[k + 1:]:
            x, y = sets[a], sets[b]
            if groups[prints[a]] == groups[prints[b]] or x and y and 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for r in rows:
        low[find(r)] = min(low.get(find(r), r), r)
    return sorted(low.values())


def planted():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    head = "this line opens a great many of the texts here ".split()
    rows = []
    for _ in range(25):
        base = head + rng.choices(words, k=rng.choice([60, 100, 160]))
        rows.append(base)
        for _ in range(6):
            copy = rng.choice([base, rows[-1]])[:]
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rows += [["only", "three", "words"], ["Only", "three", "WORDS"], ["one", "two", "three", "four", "five"], []]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return sorted((i, " ".join(r)) for i, r in zip(order, rows))


def test_near_copies_are_dropped(spark):
    rows = planted()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    want = plain_keep(rows)
    left = cp.near_dedup(spark, docs.union(docs.limit(9)), "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == want
    assert len(want) < sh.keep_one(docs).count()


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect())
    assert got == plain_keep(rows)


def test_edge_cases(spark):
    """Null ids and texts, repeated rows, a very long text and its near copy, clashing names."""
    long = " ".join(f"v{k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (None, "one two three four five six"), (None, "one two three four five six"), (3, long),
            (4, long.replace("v77 ", "other ")), (5, "four words are few"), (6, "Four words ARE few"), (7, "x"), (8, None)]
    docs = spark.createDataFrame([(i, t, "key", 1.0) for i, t in rows], "doc_id long, text string, key string, hashes double")
    left = cp.near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in left.collect()) == [(0, 27), (1, 0), (3, len(long)), (5, 18), (7, 1)]


def test_no_rows(spark):
    assert cp.near_dedup(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []
