"""The near-copy stage on a crowd of copies and many more distant ones of the same text."""

import random

import corpus_pipeline as cp
from cutline.llm import resemblance
from test_resemblance import plain_keep


def edited(rng, base, places):
    copy = base[:]
    for k in places:
        copy[k] = f"e{rng.randrange(10**9)}"
    return copy


def test_distant_copies_are_not_compared_with_the_crowd(spark, monkeypatch):
    """Near copies share a component; five edits leave a text outside, and it meets none of the crowd."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = [edited(rng, base, rng.sample(range(10, 140), 1)) for _ in range(50)]
    texts += [edited(rng, base, [k + rng.randrange(8) for k in (10, 35, 60, 85, 110)]) for _ in range(50)]
    rows = sorted(enumerate(" ".join(t) for t in texts))
    seen, verified = [], resemblance.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(resemblance, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect())
    assert got == plain_keep(rows) and len(got) == 51
    assert sum(seen) < 500, seen
