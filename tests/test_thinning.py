"""Greedy thinning against a plain loop: sparse, dense, bursty and tied times."""

import random

import numpy as np
import pytest

from cutline.operators import thinning


def greedy(rows, interval, slack):
    kept, due = set(), {}
    for key, sid, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if key not in due or t + slack >= due[key]:
            kept.add((key, sid))
            due[key] = t + interval
    return kept


def make(seed, spread):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice(spread)
        rows.append((0 if rng.random() < 0.8 else rng.randrange(1, 6), i, t))
    return rows


@pytest.mark.parametrize(
    "spread, interval, slack",
    [
        ([1, 2, 3], 500, 1),          # an interval spans many chunks
        ([1, 2, 3], 60, 0),           # about one chunk
        ([10, 50, 90], 40, 1),        # an interval holds few rows
        ([0, 0, 1, 7], 25, 1),        # ties
        ([1, 1, 1, 1, 900], 120, 0),  # bursts between silent gaps
    ],
)
def test_thinning_matches_loop(spark, tiny_chunks, spread, interval, slack):
    rows = make(interval, spread)
    df = spark.createDataFrame(rows, "asset_id long, sample_id long, t_us long")
    got = thinning.thin_min_gap(df, interval, slack).collect()
    assert len(got) == len({(r.asset_id, r.sample_id) for r in got})
    assert {(r.asset_id, r.sample_id) for r in got} == greedy(rows, interval, slack)


def test_bounds_stay_narrow_where_an_interval_spans_chunks():
    """Dense rows, one row per unit: only a few rows per chunk are candidates."""
    live = [(thinning._NEVER, thinning._NEVER)]
    candidates = 0
    for chunk in range(1000):
        first, last = chunk * 100, chunk * 100 + 99
        candidates += sum(b - a + 1 for a, b in thinning._picks(live, first, last, 1))
        live = thinning._through(live, first, last, 1, 5000)
        assert len(live) <= thinning._WINDOWS
    assert candidates < 1000


def test_rate_is_left_alone_when_the_source_is_slower(spark):
    df = spark.createDataFrame([(1, 1, 0)], "asset_id long, sample_id long, t_us long")
    assert thinning.thin_to_rate(df, 30, 30) is df


def chunks_of(times, size, interval, slack):
    """(steps, largest threshold at the start) of consecutive chunks, as the plan makes them."""
    live, out = [(thinning._NEVER, thinning._NEVER)], []
    for k in range(0, len(times), size):
        t = np.array(times[k:k + size])
        first, last, gap = int(t[0]), int(t[-1]), int(np.diff(t).max(initial=0))
        spots = thinning._merged(thinning._picks(live, first, last, gap))
        near = np.flatnonzero([any(a <= x <= b for a, b in spots) for x in t.tolist()])
        out.append((thinning._steps(t, near, interval, slack), max(hi for _, hi in live)))
        live = thinning._through(live, first, last, gap, interval - slack)
    return out


@pytest.mark.parametrize("step, interval, slack", [(10, 170, 0), (10, 173, 1), (7, 2000, 1), (3, 40, 0)])
def test_one_hot_key_at_a_regular_rate(step, interval, slack):
    """A composed function has no more steps than one interval has rows, however many chunks it spans."""
    chunks = chunks_of([k * step for k in range(20_000)], 50, interval, slack)
    phases = interval // step + 2
    at, want = np.array([thinning._NEVER]), []
    for (upto, left), _ in chunks:
        want.append(int(at[0]))
        at = thinning._apply(upto, left, at, slack)
    level, handled = chunks, 0
    while len(level) > 1:
        groups = [level[k:k + thinning.FAN] for k in range(0, len(level), thinning.FAN)]
        handled = max(handled, max(sum(len(f[0][0]) for f in g) for g in groups))
        level = [(thinning._composed([f for f, _ in g], g[0][1], slack), g[0][1]) for g in groups]
        assert max(len(f[0]) for f, _ in level) <= phases
    assert handled <= thinning.FAN * phases
    (upto, left), _ = level[0]
    assert thinning._apply(upto, left, np.array([thinning._NEVER]), slack) == at
    plain, due = [], None
    for k in range(20_000):
        if k % 50 == 0:
            plain.append(thinning._NEVER if due is None else due)
        if due is None or k * step + slack >= due:
            due = k * step + interval
    assert want == plain


def test_hot_key_in_rounds(spark):
    """One key holds nearly all rows, at a regular rate, in far more chunks than one composition takes."""
    spark.conf.set("spark.cutline.rowsPerChunk", "40")
    try:
        rows = [(0, k, k * 10) for k in range(6000)] + [(k % 7 + 1, k, k * 3) for k in range(200)]
        df = spark.createDataFrame(rows, "asset_id long, sample_id long, t_us long").repartition(6)
        got = thinning.thin_min_gap(df, 170, 0).collect()
        assert {(r.asset_id, r.sample_id) for r in got} == greedy(rows, 170, 0) and len(got) == len(set(got))
    finally:
        spark.conf.unset("spark.cutline.rowsPerChunk")
