"""Literal solver cases and random properties of the interval algebra."""

import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import intervals as B

CASES = [
    ("no cut", [], [(0, 100)]),
    ("one inner", [(20, 30)], [(0, 20), (30, 100)]),
    ("two inner", [(20, 30), (50, 60)], [(0, 20), (30, 50), (60, 100)]),
    ("overlapping", [(20, 50), (40, 60)], [(0, 20), (60, 100)]),
    ("touching", [(20, 40), (40, 60)], [(0, 20), (60, 100)]),
    ("covering the start", [(-10, 30)], [(30, 100)]),
    ("covering everything", [(-10, 200)], []),
    ("outside", [(150, 200), (-50, -20)], [(0, 100)]),
    ("zero length", [(50, 50)], [(0, 50), (50, 100)]),
    ("unsorted", [(60, 70), (10, 20)], [(0, 10), (20, 60), (70, 100)]),
]


def solve(lo, hi, cuts):
    out, cursor = [], lo
    for a, b in sorted((max(lo, min(hi, a)), max(lo, min(hi, b))) for a, b in cuts):
        if a > cursor:
            out.append((cursor, a))
        cursor = max(cursor, b)
    if cursor < hi:
        out.append((cursor, hi))
    return out


def frames(spark, assets, cuts):
    a = spark.createDataFrame(assets, "asset_id long, in_us long, out_us long")
    return a, spark.createDataFrame(cuts, "asset_id long, st_us long, en_us long")


def by_asset(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.asset_id, []).append((r.st_us, r.en_us))
    return {k: sorted(v) for k, v in out.items()}


def test_solver_cases(spark):
    a, c = frames(
        spark,
        [(i, 0, 100) for i in range(len(CASES))] + [(99, 60, 40)],
        [(i, s, e) for i, (_, cuts, _) in enumerate(CASES) for s, e in cuts] + [(99, 10, 20)],
    )
    got = by_asset(B.keep_ranges(a, c))
    for i, (name, _, want) in enumerate(CASES):
        assert got.get(i, []) == want, name
    assert 99 not in got  # in after out keeps nothing


@pytest.fixture(scope="module")
def world():
    rng = random.Random(11)
    assets = [(i, 100, 1100) for i in range(12)]
    # Asset 0 owns about a third of all cuts.
    owners = [0 if rng.random() < 0.33 else rng.randrange(1, 12) for _ in range(150)]
    cuts = []
    for o in owners:
        st = rng.randrange(0, 1200)
        cuts.append((o, st, st + rng.randrange(0, 90)))
    return assets, cuts


def test_keep_and_cuts_tile_the_window(spark, tiny_chunks, world):
    assets, cuts = world
    a, c = frames(spark, assets, cuts)
    keep = by_asset(B.keep_ranges(a, c))
    for i, lo, hi in assets:
        mine = [(s, e) for k, s, e in cuts if k == i]
        assert keep.get(i, []) == solve(lo, hi, mine)
    clipped = by_asset(B.merge_intervals(B.clip_intervals(a, c, 0), 0))
    for i, lo, hi in assets:
        pieces = sorted(keep.get(i, []) + clipped.get(i, []))
        joined = [pieces[0][0]]
        for s, e in pieces:
            assert s == joined[-1]
            joined.append(e)
        assert (joined[0], joined[-1]) == (lo, hi)


def test_merge_is_idempotent_and_keeps_the_total(spark, tiny_chunks, world):
    a, c = frames(spark, *world)
    merged = B.merge_intervals(B.clip_intervals(a, c, 0), 0)
    assert by_asset(B.merge_intervals(merged, 0)) == by_asset(merged)
    kept = {r.asset_id: r.kept_us for r in B.kept_duration(a, B.keep_ranges(a, c)).collect()}
    left = {r.asset_id: r.kept_us for r in B.floored_duration(a, merged, 0).collect()}
    assert kept == left


def test_output_time_round_trip(spark, tiny_chunks, world):
    a, c = frames(spark, *world)
    points = spark.createDataFrame(
        [(i, n, t) for i in range(12) for n, t in enumerate(range(90, 1110, 7))],
        "asset_id long, sample_id long, t_us long",
    )
    keep = B.keep_ranges(a, c).cache()
    out = B.to_output_time(points, keep).cache()
    back = B.from_output_time(
        out.where("kept").select("asset_id", "sample_id", F.col("out_us").alias("o_us")), keep, a
    )
    both = out.where("kept").join(back.withColumnRenamed("t_us", "b_us"), ["asset_id", "sample_id"])
    # A range's first instant shares its output time with the end of the range before.
    firsts = keep.select("asset_id", F.col("st_us").alias("t_us"))
    wrong = both.where("t_us <> b_us").join(firsts, ["asset_id", "t_us"], "left_anti")
    assert wrong.count() == 0 and both.count() > 100
    lost = {(r.asset_id, r.sample_id) for r in B.drop_cut_samples(points, c).collect()}
    inside = {(r.asset_id, r.sample_id) for r in out.where("kept").collect()}
    windowed = {
        (r.asset_id, r.sample_id)
        for r in B.trim_window(points, a, 0).collect()
    }
    assert inside == lost & windowed


def test_marks(spark, tiny_chunks):
    acts = [
        (0, "commit"), (5_000, "arm"), (9_000, "commit"), (9_500, "commit"), (10_000, "arm"),
        (12_000, "arm"), (20_000, "commit"), (21_000, "clear"), (30_000, "arm"), (31_000, "clear"),
        (40_000, "commit"), (50_000, "arm"), (50_900, "commit"), (60_000, "arm"), (70_000, "commit"),
    ]
    df = spark.createDataFrame(
        [(1, t, i, act) for i, (t, act) in enumerate(acts)],
        "asset_id long, t_us long, sample_id long, act string",
    )
    got = sorted((r.st_us, r.en_us, r.live) for r in B.intervals_from_marks(df).collect())
    assert got == [(5_000, 9_000, False), (12_000, 20_000, False), (60_000, 70_000, True)]
