"""Base counts and distances against plain loops."""

import math
import re
from collections import Counter

from cutline.llm import divergence as dv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    cover = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k:k + 3])] > 1:
            cover |= {k, k + 1, k + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover))


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda u: sum(a * math.log2(a / b) for a, b in zip(u, m) if a)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


ODD = ["", None, " \x1f\x85é\x0b|x", "a a a a", "x\n\nx\n x\nx\r\n" * 40, "wörter und " * 9000, "AB!! " * 300]


def test_against_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(-1 - k, t, "en") for k, t in enumerate(ODD)] + [(None, ODD[5], None), rows[0]]
    frame = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, lang string, kept boolean, n_words int")
    got = {r.doc_id: r for r in dv.judge(frame, min_reference=10).collect()}
    assert dv.judge(frame).count() == len(rows)
    refs = {}
    for _, text, lang in rows:
        counts = dv.base_counts((text or "").encode())
        old = refs.setdefault(lang, [0, [0] * len(dv.CLASSES), [0] * len(dv.COMMON_WORDS)])
        refs[lang] = [old[0] + counts[0], [a + b for a, b in zip(old[1], counts[5].tolist())],
                      [a + b for a, b in zip(old[2], counts[6].tolist())]]
    rejected = 0
    for i, text, lang in rows:
        want, row = plain(text or ""), got[i]
        assert tuple(row[c] for c in dv.BASE) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        counts, room = dv.base_counts((text or "").encode()), 0.6 / math.sqrt(max(1, want[0]))
        far = False
        if want[0] >= 50 and refs[lang][0] >= 10:
            d = distance(counts[5].tolist(), refs[lang][1])
            assert abs(row.class_distance - d) < 1e-9
            far = d > 0.25 + room
            if sum(counts[6]) >= 20:
                d = distance(counts[6].tolist(), refs[lang][2])
                assert abs(row.common_distance - d) < 1e-9
                far |= d > 0.75 + room
        else:
            assert row.class_distance is None and row.common_distance is None
        assert row.kept == (not row.base_failed and not far)
        rejected += far
    assert rejected
    left = dv.keep(frame, min_reference=10)
    assert left.columns == frame.columns
    assert sorted((str(r.doc_id) for r in left.collect())) == sorted(str(i) for i, _, _ in rows if got[i].kept)


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    out = dv.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    clean = out.where("quality = 1 and not base_failed")
    assert clean.where("not kept").count() == 0
    assert out.where("quality = 0 and not kept").count() > 0.4 * out.where("quality = 0").count()


def test_empty_table(spark):
    assert dv.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
