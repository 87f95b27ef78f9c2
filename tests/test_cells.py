"""Codebooks, deltas and replay beyond what SQL can check."""

import random

import numpy as np
import pytest

from cutline.functions.colormaps import builtin_luts, tone_curve
from cutline.operators import codebook as K
from cutline.operators import deltas as N

RGBA = ["r", "g", "b", "a"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = [(i, *[rng.randrange(256) for _ in range(4)]) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, r int, g int, b int, a int").cache()


def plain_codebook(x, k):
    """One split at a time, straight from the rule."""
    def axis(v):
        n, m = len(v), v.sum(0)
        cov = v.T @ v - np.outer(m, m) / n
        e, w = np.full(4, 0.5), 0.0
        for _ in range(10):
            e = cov @ e
            size = np.sqrt(e @ e)
            e = e / size
            if abs(size - w) < 1e-9:
                break
            w = size
        return e, w, e @ (m / n)

    leaves = [np.arange(len(x))]
    while len(leaves) < k:
        stats = [axis(x[i]) for i in leaves]
        at = max(range(len(leaves)), key=lambda i: stats[i][1])
        e, w, cut = stats[at]
        if w < 1e-3:
            break
        left = x[leaves[at]] @ e <= cut
        leaves.append(leaves[at][~left])
        leaves[at] = leaves[at][left]
    return sorted(len(i) for i in leaves)


def test_codebook_partitions_the_points(spark, points):
    rows, df = points
    x = np.array([r[1:] for r in rows]) / 255
    book = K.pca_split_codebook(df, RGBA, 9, 1 / 255)
    table = book.table(spark).collect()
    assert sorted(r.n for r in table) == plain_codebook(x, 9)
    sizes = {r.code: r["count"] for r in book.assign(df).groupBy("code").count().collect()}
    assert sizes == {r.code: r.n for r in table} and sum(sizes.values()) == len(rows)
    assert [r.n for r in table] == sorted((r.n for r in table), reverse=True)


def test_flat_points_are_not_split(spark):
    df = spark.createDataFrame([(7, 7, 7, 255)] * 20, "r int, g int, b int, a int")
    assert len(K.pca_split_codebook(df, RGBA, 8, 1 / 255).codes) == 1


def test_nearest_takes_more_codes_than_a_palette(spark, points):
    many = spark.range(300).selectExpr("cast(id as int) as code", "id as r")
    got = K.assign_nearest(points[1], many, ["r"])
    assert got.count() == points[1].count() and got.where("code <> r").count() == 0


def over(top, under):
    """Source-over of two RGBA pixels, truncated to bytes."""
    fa, ba = top[3] * (1 / 255), under[3] * (1 / 255)
    keep = 1 - fa
    oa = fa + ba * keep
    if oa == 0:
        return (0, 0, 0, 0)
    return (*[int((t * fa + u * ba * keep) * (1 / oa)) for t, u in zip(top[:3], under[:3])], int(255 * oa))


def replay(frames, w, h):
    """Straight replay of (box, blend, dispose, pixels) frames."""
    canvas, shown = np.zeros((h, w, 4), int), []
    for i, (x, y, bw, bh, blend, dispose, px) in enumerate(frames):
        for dy in range(bh):
            for dx in range(bw):
                top, under = tuple(px[dy][dx]), tuple(canvas[y + dy][x + dx])
                canvas[y + dy][x + dx] = over(top, under) if blend and i else top
        shown.append(canvas.copy())
        if dispose == 1:
            canvas[y:y + bh, x:x + bw] = 0
        elif dispose == 2:
            p = i - 1
            while frames[p][5] == 2:
                p -= 1
            canvas = shown[p].copy()
    return shown


@pytest.mark.parametrize("seed, count, chunk", [(9, 12, None), (10, 40, None), (11, 40, 7)])
def test_replay_with_all_disposals(spark, seed, count, chunk):
    if chunk:
        spark.conf.set("spark.cutline.rowsPerChunk", str(chunk))
    rng = random.Random(seed)
    frames = []
    for i in range(count):
        x, y = (0, 0) if i == 0 else (rng.randrange(3), rng.randrange(2))
        bw, bh = (4, 3) if i == 0 else (rng.randrange(1, 5 - x), rng.randrange(1, 4 - y))
        px = [[[*(rng.randrange(256) for _ in range(3)), rng.choice([0, 255, rng.randrange(256)])] for _ in range(bw)] for _ in range(bh)]
        frames.append((x, y, bw, bh, rng.randrange(2), 0 if i == 0 else rng.randrange(3), px))
    meta = spark.createDataFrame(
        [(1, i, *f[:6]) for i, f in enumerate(frames)],
        "anim_id long, seq long, box_x int, box_y int, box_w int, box_h int, blend int, dispose int",
    )
    deltas = spark.createDataFrame(
        [(1, i, f[0] + dx, f[1] + dy, *f[6][dy][dx])
         for i, f in enumerate(frames) for dy in range(f[3]) for dx in range(f[2])],
        "anim_id long, seq long, x int, y int, r int, g int, b int, a int",
    )
    want = replay(frames, 4, 3)
    got = N.replay_disposed(deltas, meta, 4, 3).collect()
    if chunk:
        spark.conf.unset("spark.cutline.rowsPerChunk")
    assert len(got) == len({(r.seq, r.x, r.y) for r in got}) == count * 12
    for r in got:
        assert (r.r, r.g, r.b, r.a) == tuple(want[r.seq][r.y][r.x]), (r.seq, r.x, r.y)


def test_replay_cuts_a_pixel_into_segments():
    """A thousand draws of one pixel, every tenth opaque: folded in steps of ten, not a thousand."""
    n = 1000
    rng = np.random.default_rng(3)
    px = rng.integers(0, 255, (n, 4)).astype(float)
    px[::10, 3] = 255
    rows = {"px": px, "over": np.ones(n, bool), "dispose": np.zeros(n, int), "next": np.zeros(n, int), "gap": np.zeros(n, int)}
    whole, last = N._fold(np.arange(n) == 0, rows, np.zeros((2, 4)))
    cut, end = N._fold(np.arange(n) % 10 == 0, rows, np.zeros((2, 4)))
    assert (whole == cut).all() and (last == end).all()


def test_default_curve_is_not_the_identity():
    table = tone_curve(0, 128, 255)
    assert [x for x in range(256) if table[x] != x] == list(range(64, 128))
    assert all(table[x] == x + 1 for x in range(64, 128))


def test_builtin_maps(spark):
    rows = {(r.map_key, r.idx): (r.r, r.g, r.b) for r in builtin_luts(spark).collect()}
    assert len(rows) == 18 * 256
    assert rows["gray", 77] == (77, 77, 77) and rows["black-blue", 200] == (0, 0, 200)
    assert rows["hot", 0] == (11, 0, 0) and rows["jet", 0] == (0, 0, 128)
    assert rows["bone", 4] == (4, 3, 5) and rows["copper", 3] == (4, 2, 1)
    assert rows["Reds", 0] == (255, 245, 240) and rows["Spectral", 255] == (94, 79, 162)
