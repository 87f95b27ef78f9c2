"""Matches against Dice over every template and segment."""

import re
from collections import Counter

from cutline.llm import licenses as lc


def dice(a, b):
    a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


def plain(text, threshold=0.8):
    out = []

    def look(s, e):
        words = lc.normalised(text[s:e])
        hits = [(-d, n) for n, t in lc.TEMPLATES if (d := dice(words, lc.normalised(t))) >= threshold]
        if hits and not any(n == min(hits)[1] and a >= s and b <= e for n, a, b, _ in out):
            out.append((min(hits)[1], s, e, -min(hits)[0]))

    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), bool(line.strip())))
        look(at, at + len(line))
        at += len(line) + 1
    block = []
    for s, e, full in [*lines, (at, at, False)]:
        if full:
            block.append((s, e))
        else:
            if len(block) > 1:
                look(block[0][0], block[-1][1])
            block = []
    rows = [x for x in lines if x[2]]
    if len(rows) > 1:
        look(rows[0][0], rows[-1][1])
    return out


MIT = lc.TEMPLATES[[n for n, _ in lc.TEMPLATES].index("MIT") + 1][1]
ODD = ["", None, "prose\n\n" + "\n".join(MIT[k:k + 80] for k in range(0, len(MIT), 80)) + "\n\nmore prose",
       "Released under the  MIT license", "released under a MIT-like License today maybe", "x\n" * 20_000,
       "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\n", "\n \n", "w " * 50_000,
       "This work is licensed under the GNU General Public License,\nversion 3."]


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1 - k, t) for k, t in enumerate(ODD)] + [(None, ODD[3]), (-4, ODD[3])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, dice int")
    got = sorted((tuple(r) for r in lc.scan(frame).collect()), key=str)
    want = sorted(((i, *h) for i, t in rows for h in plain(t or "")), key=str)
    assert got == want
    notices = {t for _, t in lc.TEMPLATES}
    held = {i for i, t in rows for line in re.split("\n", t or "") if line in notices}
    assert held <= {g[0] for g in got}
    assert [g[1] for g in got if g[0] == -3] and [g[1] for g in got if g[0] == -10]


def test_empty_table(spark):
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
