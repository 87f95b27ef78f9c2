"""Leaks against a plain loop over canonical words, and planted cases."""

import re

from cutline.llm import decontam as dc


def canon(text):
    """[(canonical word, raw value)]"""
    out, first = [], True
    for token in re.findall(r"\n|[^\x20\x09-\x0D]+", (text or "").replace("\x01", " ")):
        if token == "\n":
            first = True
            continue
        for w in dc.canonical(token, first):
            out.append((w, token.strip(dc._EDGE)))
        first = token.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
    return out


def plain(docs, items, window=8, min_words=5, min_cover=0.6):
    out = set()
    templates = {}
    for j, text in sorted(items):
        c = canon(text)
        if len(c) >= min_words:
            templates.setdefault(tuple(c), j)
    for i, text in docs:
        d = canon(text)
        for c, j in templates.items():
            size = min(window, len(c))
            n = max(1, len(c) - window + 1)
            lines = {}
            for p in range(len(c) - size + 1):
                want = [w for w, _ in c[p:p + size]]
                for a in range(len(d) - size + 1):
                    if [w for w, _ in d[a:a + size]] == want:
                        lines.setdefault(a - p, []).append((p, a))
            met = set()
            for hits in lines.values():
                pairs = {(c[p + k][1], d[a + k][1]) for p, a in hits for k in range(size) if c[p + k][0] in ("<num>", "<name>", "<unit>")}
                if len(pairs) == len({x for x, _ in pairs}):
                    met |= {p for p, _ in hits}
            if len(met) / n >= min_cover:
                out.add((i, j, round(len(met) / n, 9)))
    return out


ITEMS = [
    (1, "If Alice has 5 apples and gives Bob 5 of the 12 kg she bought, how many apples does Alice keep?"),
    (2, "The quick brown fox jumps over it."), (3, "too short"), (4, None), (5, ""),
    (6, "If Alice has 5 apples and gives Bob 5 of the 12 kg she bought, how many apples does Alice keep?"),
]
DOCS = [
    (10, "Intro text. If Carol has 9 apples and gives Dave 9 of the 30 lb she bought, how many apples does Carol keep? The end."),
    (11, "If Carol has 9 apples and gives Dave 8 of the 30 kg she bought, how many apples does Erin keep?"),
    (12, "well THE QUICK brown fox, jumps over it -- yes"), (13, "quick brown fox jumps over"), (14, None), (15, ""),
    (None, "the quick brown fox jumps over it"), (10, "nothing here at all"), (17, "too short"),
    (18, "\x01 ... !!! 5 5 5 5 5 5"),
]


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, h int"),
            spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string"))


def found(frame):
    return {(r.doc_id, r.item_id, round(r.cover, 9)) for r in frame.collect()}


def test_planted_cases(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    got = found(dc.leaks(docs, items))
    assert got == plain(DOCS, ITEMS)
    assert {g[:2] for g in got} == {(10, 1), (12, 2), (None, 2)}
    left = dc.without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(
        str(d) for d in DOCS if d not in (DOCS[0], DOCS[2], DOCS[6]))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    docs, items = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()]
    long = (-1, "word " * 30_000 + items[3][1] + " tail" * 30_000)
    docs.append(long)
    wide = d.select("doc_id", "text").union(spark.createDataFrame([long], "doc_id long, text string"))
    got = found(dc.leaks(wide.union(wide), b))
    held = {(i, j) for i, t in docs for j, x in items if x in t}
    assert held <= {g[:2] for g in got}
    few = [x for x in docs if x[0] in {g[0] for g in got} - {-1}] + docs[:20]
    assert {g for g in got if g[0] in dict(few)} == plain(few, items)


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert dc.leaks(docs.limit(0), items).collect() == []
    assert dc.leaks(docs, items.limit(0)).collect() == []
    assert dc.without_leaks(docs, items.limit(0)).count() == len(DOCS)
