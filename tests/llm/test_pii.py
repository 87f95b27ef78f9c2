"""Base spans against the plain patterns, the model against enumeration."""

import hashlib
import itertools
import math
import random
import re

from cutline.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_against_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("a1.@+- ()%0é92") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("x 4539578763621486 y 4539-5787-6362-1486") == [(2, 2, 18), (2, 21, 40)]
    for long in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000, "1 " * 100_000):
        pii.base_spans(long)


def test_partition_and_best_by_enumeration():
    rng = random.Random(2)
    text = "tel (017) 555-7713 or 10.2.3.4"
    lat = pii.lattice(text, 0, len(text))
    feats = {f for seg in lat.segments for _, _, fs in seg for f in fs}
    weights = {k: {"": rng.uniform(-2, 0), **{f: rng.uniform(-1, 1) for f in sorted(feats)}} for k in range(4)}
    segments = [(i, j, k, pii._score(weights, k, f)) for j, seg in enumerate(lat.segments) for i, k, f in seg]

    def paths(j):
        if j == 0:
            return [(0.0, [])]
        out = list(paths_of[j - 1])
        for i, e, k, s in segments:
            if e == j - 1:
                out += [(p + s, q + [(i, e, k)]) for p, q in paths_of[i]]
        return out

    paths_of = []
    for j in range(len(lat.segments) + 1):
        paths_of.append(paths(j))
    every = paths_of[-1]
    total = math.log(sum(math.exp(p) for p, _ in every))
    got, posts = pii.expected(weights, lat)
    assert abs(got - total) < 1e-9
    for (i, e, k, _), (kind, _, p) in zip(segments, posts):
        want = sum(math.exp(s - total) for s, q in every if (i, e, k) in q)
        assert kind == k and abs(p - want) < 1e-9
    best = max(every, key=lambda x: x[0])
    assert pii.best_segments(weights, lat) == [(k, lat.starts[i], lat.ends[e]) for i, e, k in best[1]]


ODD = ["", None, "mail bob.smith@ex.org, +1 (017) 555-7713!", "call (212) 555-0188 today", "write jane.doe (at) mail.example.org now",
       "9" * 30_000, "version 1.2 of 2019, page 12345", "999.1.1.1 and 1.2.3.4.5", "é 4539578763621486"]


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(-1 - k, t) for k, t in enumerate(ODD)] + [(None, ODD[2]), rows[3]]
    frame = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, n_chars long, spans string")
    weights = pii.fit(frame)
    got = pii.find(frame, weights).collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in got}
    added = 0
    for i, t in rows:
        want, r = plain(t or ""), out[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(spans)
        added += len(spans) - len(want)
    assert out[-4].spans == "phone:5:19"
    assert out[-5].spans == "email:6:36"
    assert out[-7].spans == "" and out[-6].spans == ""
    assert added < 20
    red = pii.redact(frame, weights)
    assert red.columns == frame.columns and red.count() == len(rows)
    text = {r.doc_id: r for r in red.collect()}
    assert text[-3].text == "mail [EMAIL], [PHONE]!" and text[-3].n_chars == 22
    assert text[-2].text is None and text[-1].text == ""


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(none).collect() == [] and pii.redact(none).collect() == []


def test_masked_overlaps():
    assert pii.masked("abcdefgh", [(0, 1, 3), (2, 2, 5), (1, 6, 7)]) == "a[EMAIL]f[IP]h"
