"""Plain readings of the filtering stages, for the pipeline test."""

import math

from test_decontam import plain as leaks_plain
from test_divergence import distance
from test_divergence import plain as counts_plain
from test_resemblance import shingles
from test_simhash import plain_groups, plain_print

from cutline.llm import divergence as dv


def divergence_plain(row, rows):
    """Does the document stay?  `row` is (doc_id, text, lang, ...)."""
    text, lang = row[1] or "", row[2]
    n, _, _, _, repeats = counts_plain(text)
    if n < 50 or 100 * repeats > 50 * n:
        return False
    own = dv.base_counts(text.encode())
    room = 0.6 / math.sqrt(n)
    refs = [dv.base_counts((r[1] or "").encode()) for r in rows if r[2] == lang]
    if sum(r[0] for r in refs) < 2000:
        return True
    classes, common = (sum(r[k] for r in refs).tolist() for k in (5, 6))
    if distance(own[5].tolist(), classes) > 0.25 + room:
        return False
    return own[6].sum() < 20 or distance(own[6].tolist(), common) <= 0.75 + room


def near_plain(rows):
    """One row a group: texts whose fingerprints link, or whose 5-word shingles are 0.8 similar."""
    texts = sorted({r[1] or "" for r in rows})
    prints = {t: plain_print(t) for t in texts}
    groups = plain_groups(set(prints.values()))
    sets = {t: shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[k + 1:]:
            x, y = sets[a], sets[b]
            if groups[prints[a]] == groups[prints[b]] or x and y and 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for r in rows:
        g, key = find(r[1] or ""), (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    return [r for _, r in best.values()]


def decontam_plain(docs, items):
    """Ids of documents that hold an item; first the cheap test for whole passages."""
    return {i for i, _, _ in leaks_plain(docs, items)}
