"""Removed words against brute force over all windows."""

import hashlib
import re

from cutline.llm import substrings as ss

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    """Words kept per row; a null id comes after every id."""
    first = {}
    split = [(ss.LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - width + 1):
            w = tuple(words[k:k + width])
            first[w] = min(i, first.get(w, i))
    out = []
    for (i, words), (doc, _) in zip(split, rows):
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k:k + width])] < i:
                gone.update(range(k, k + width))
        out.append((doc, " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, ["x"]) for r in rows], "doc_id long, text string, ord int, marks array<string>")


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    passage = " ".join(f"w{k}" for k in range(60))
    rows += [(-1, ""), (-2, None), (-3, "a b \x1f c\x85d " * 3000), (None, rows[5][1]), (None, passage), rows[7],
             (9001, f"pre {passage} post"), (9002, f"{passage}\n{passage}"), (9003, passage[:150])]
    want = sorted(plain(rows, 50), key=str)
    got = sorted((tuple(r) for r in ss.drop_repeats(frame(spark, rows)).collect()), key=str)
    assert got == want
    assert sum(r[3] for r in want) > 1000
    # a sketch in which nearly every cell is shared loses none
    assert sorted((tuple(r) for r in ss.drop_repeats(frame(spark, rows), log_width=16).collect()), key=str) == want


def test_short_windows_and_ties(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "x b c d e y"), (2, "b c d e"), (4, "a a a a a a a"),
            (5, "z a a a a"), (6, ""), (None, "b c d e"), (None, "q r s t")]
    want = sorted(plain(rows, 4), key=str)
    assert sorted((tuple(r) for r in ss.drop_repeats(frame(spark, rows), width=4, inner=2).collect()), key=str) == want


def test_query_digest_and_empty_table(spark, tmp_path):
    rows = [(1, "a b"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in ss.op5_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert ss.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
