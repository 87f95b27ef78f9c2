"""The ways behind a size check, and settings other than the usual ones."""

import sys
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

from cutline import fixtures as X  # noqa: E402
from cutline.functions.colormaps import builtin_luts  # noqa: E402
from cutline.operators import forms, intervals, text  # noqa: E402
from cutline.operators import codebook as K  # noqa: E402
from cutline.operators import planning as G  # noqa: E402
from cutline.operators import sampling as C  # noqa: E402
from cutline.operators import tone as D  # noqa: E402
from cutline.plans import scan as S  # noqa: E402
from cutline.plans.topn import first_n  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["h3_form_fill_stats", "h2_typed_values"])
def test_without_ansi(spark, name):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("name", ["b5_kept_samples", "c4_thin_min_gap", "f2_best_predecessor"])
def test_scans_without_broadcast(spark, tiny_chunks, monkeypatch, name):
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_options_by_join(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_OPTIONS", 0)
    name = "g4_first_supported"
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_many_options_without_pairs(spark):
    """100 000 options, 300 sizes: no step makes anything like their product, and the first option is right."""
    rng = np.random.default_rng(6)
    n = 100_000
    w, h = rng.integers(100, 4000, n), rng.integers(100, 4000, n)
    rank = rng.permutation(n)
    codec = np.where(rng.random(n) < 0.7, "avc", "hevc")
    accel = rng.integers(0, 2, n)
    supports = spark.createDataFrame(
        [(c, int(a), int(r), f"o{r}", int(x), int(y)) for c, a, r, x, y in zip(codec, accel, rank, w, h)],
        "codec string, accel_rank int, rank int, option string, max_w int, max_h int")
    asks = [(k, ["avc", "hevc"][k % 2], int(a), int(b)) for k, (a, b) in enumerate(rng.integers(100, 4100, (300, 2)))]
    asks += [(900, "avc", None, 5), (901, "avc", 3999, 3999), (902, "hevc", 100, 100)]
    requests = spark.createDataFrame(asks, "job_id int, codec string, w int, h int")

    def first(c, a, b):
        fits = (codec == c) & (w >= a) & (h >= b)
        return f"o{min(zip(accel[fits], rank[fits]))[1]}" if fits.any() else None

    got = {r.job_id: r for r in G.first_supported(requests, supports).collect()}
    assert len(got) == len(asks)
    for k, c, a, b in asks:
        own = None if a is None else first(c, a, b)
        other = None if a is None else first("avc" if c == "hevc" else "hevc", a, b)
        assert got[k].option == own
        assert got[k].advice == ("ok" if own else f"switch to {'avc' if c == 'hevc' else 'hevc'}" if other else "pick a smaller size")


def test_moments_of_many_groups(spark, monkeypatch):
    """More groups than a task holds, null keys included: the same sums."""
    monkeypatch.setattr(K, "GROUPS", 3)
    rows = [(None if k % 11 == 0 else k % 7, k % 2, float(k % 5), float(k % 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, h int, a double, b double").repartition(3)
    got = {(r.g, r.h, r.i, r.j): (r.n, r.s) for r in K.moment_stats(df, ["a", "b"], ["g", "h"]).collect()}
    want = {}
    for g, h, *v in rows:
        for i, j in ((0, 0), (0, 1), (1, 1)):
            n, s = want.get((g, h, i, j), (0, 0.0))
            want[g, h, i, j] = (n + 1, s + v[i] * v[j])
    assert got == want


def test_nearest_of_many_codes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = [(i, *map(float, v)) for i, v in enumerate(rng.integers(0, 6, (60, 3)))]
    codes = [(i, *map(float, v)) for i, v in enumerate(rng.integers(0, 6, (40, 3)))]
    p = spark.createDataFrame(points, "id long, a double, b double, c double")
    q = spark.createDataFrame(codes, "code int, a double, b double, c double")
    want = {i: min((sum((u - w) ** 2 for u, w in zip(v, c[1:])), c[0]) for c in codes)[1] for i, *v in points}
    for held, cell in ((4096, 8), (7, 2), (39, 4)):
        monkeypatch.setattr(K, "HELD_CODES", held)
        monkeypatch.setattr(K, "CELL_CODES", cell)
        got = K.assign_nearest(p.union(p), q, ["a", "b", "c"]).collect()
        assert len(got) == 120 and all(want[r.id] == r.code for r in got)


def test_nearest_in_plane_with_many_targets(spark, monkeypatch):
    """Crowded, repeated and far points: cells dealt to several tasks, no pairs of points and targets."""
    monkeypatch.setattr(K, "HELD_CODES", 500)
    monkeypatch.setattr(K, "CELL_POINTS", 200)
    rng = np.random.default_rng(12)
    t = np.concatenate([rng.normal(size=(3000, 2)), np.zeros((1500, 2)), rng.integers(-9, 9, (500, 2)) * 10.0])
    p = np.concatenate([rng.normal(size=(300, 2)) * 5, np.zeros((600, 2)), t[:100], [[1e6, -1e6]]])
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "point_id int, px double, py double")
    targets = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(t)], "ord int, px double, py double")
    d = ((p[:, None, :] - t[None]) ** 2)
    want = (d[..., 0] + d[..., 1]).argmin(axis=1)
    got = forms.nearest_in_plane(points, targets).collect()
    assert len(got) == len(p) and all(r.ord == want[r.point_id] for r in got)


def test_plane_tree_is_exact_and_prunes():
    """Every tree over random, clustered, repeated and collinear codes against all distances."""
    rng = np.random.default_rng(7)
    for size, dims, leaf in ((1, 3, 8), (200, 4, 1), (500, 2, 8), (64, 64, 4), (300, 1, 2)):
        centres = rng.normal(size=(size, dims)).round(1) + rng.integers(0, 4, (size, 1)) * 5
        tree = K.PlaneTree.over(centres, np.arange(size) * 10, leaf)
        x = np.concatenate([rng.normal(size=(400, dims)) * 6, centres])
        d = ((x[:, None, :] - centres[None]) ** 2)
        d = np.array([[float(np.add.accumulate(v)[-1]) for v in row] for row in d])
        best, code = tree.nearest(x)
        assert (code == d.argmin(axis=1) * 10).all() and np.allclose(best, d.min(axis=1))
    tree = K.PlaneTree.over(rng.normal(size=(4096, 3)), np.arange(4096))
    x = rng.normal(size=(1000, 3))
    first = tree.nearest(x)[0]
    seen = sum(len(who) * len(tree.rows[leaf]) for leaf, who in tree.leaves_within(x, first))
    assert seen < 0.1 * 1000 * 4096


def test_nearest_of_a_learnt_codebook(spark):
    """The nearest mean may lie beyond a plane; the search finds it where the walk does not."""
    rng = np.random.default_rng(9)
    rows = [(i, *map(int, v)) for i, v in enumerate(np.clip(rng.normal(128, 60, (1500, 4)), 0, 255))]
    df = spark.createDataFrame(rows, "id int, r int, g int, b int, a int")
    book = K.pca_split_codebook(df, list("rgba"), 24, 1 / 255)
    means = np.array([nd.mean for nd in book.codes])
    x = np.array([r[1:] for r in rows]) * (1 / 255)
    want = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
    got = {r.id: r.code for r in book.nearest(df).collect()}
    assert all(np.isclose(want[k, got[k]], want[k].min(), rtol=1e-12) for k in range(len(rows)))
    walked = {r.id: r.code for r in book.assign(df).collect()}
    assert sum(walked[k] != got[k] for k in got) > 0


def test_maps_round_as_published(spark):
    rows = {(r.map_key, r.idx): (r.r, r.g, r.b) for r in builtin_luts(spark).collect()}
    assert [rows["jet", k] for k in (0, 1, 2)] == [(0, 0, 128), (0, 0, 132), (0, 0, 137)]
    assert [rows["bone", k] for k in (1, 3, 4, 10)] == [(1, 1, 1), (3, 3, 4), (4, 3, 5), (9, 9, 12)][:3] + [rows["bone", 10]]
    assert [rows["rainbow", k] for k in (0, 1, 2)] == [(128, 0, 255), (126, 3, 255), (124, 6, 255)]
    cells = spark.createDataFrame([(1, 2, 3, 4)], "r int, g int, b int, a int")
    with pytest.raises(ValueError):
        D.colormap(cells, builtin_luts(spark), "viridis")


def test_many_short_ranges_spread(spark):
    keep = spark.range(20_000).selectExpr("1L as asset_id", "id * 1000 as st_us", "id * 1000 + 600 as en_us")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = C.uniform_grid(keep, 250).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r[1] for r in parts) < 2 * sum(r[1] for r in parts) / len(parts)


def test_first_n_beyond_the_rank_limit(spark):
    rows = spark.range(9000).selectExpr("id % 2 as k", "id")
    out = first_n(rows, ["k"], [F.desc("id")], 1500, "rank").collect()
    assert len(out) == 3000 and min(r.id for r in out) == 6000
    assert all(r.rank == (8999 - r.id) // 2 + 1 for r in out)
    assert X.table(spark, SF, "region").count() == 5


def test_scopes_from_a_table(spark):
    """Thousands of scopes give what the expressions give: longer, typed, later ones win, own values stay."""
    rng = np.random.default_rng(3)
    part = ["", "a", "a/", "a/b", "a/b/c", "ab", "b/"]
    scopes, rows = [], []
    for k in range(60):
        path, kind = part[rng.integers(7)], [None, "posts", "pages"][rng.integers(3)]
        values = {f"k{j}": f"v{k}" for j in rng.integers(0, 5, 2)}
        scopes.append({"path": path, "type": kind, "values": values})
        rows += [(path or None, kind, k, key, v) for key, v in values.items()]
    far = [(f"z/{k}/", None, k, "k0", "far") for k in range(10_000)]
    kind = "path string, type string, ord int, key string, value string"
    pages = [(f"{part[k % 7]}x{k % 9}", ["posts", "pages", "other"][k % 3], {"k1": "own", "mine": "m"} if k % 4 else {"k2": None})
             for k in range(200)] + [("z/77/q", None, {}), ("", "posts", None)]
    df = spark.createDataFrame(pages, "path string, type string, front map<string,string>")
    table = text.apply_default_table(df, spark.createDataFrame(rows + far, kind))
    plain = text.apply_defaults(df.withColumn("front", F.coalesce("front", F.create_map().cast("map<string,string>"))), scopes)
    keys = [f"k{j}" for j in range(5)] + ["mine"]
    pick = lambda d: sorted((str(r) for r in d.select("path", "type", *[F.col("front")[k].alias(k) for k in keys]).where("path not like 'z/%'").collect()))
    assert pick(table) == pick(plain) and table.count() == len(pages)
    assert table.where("path = 'z/77/q'").first().front["k0"] == "far"
    assert text.apply_default_table(df, spark.createDataFrame([], kind)).count() == len(pages)


def test_capped_palette(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUPS", 2)
    rows = [(a, k % n, 0, 1, 255) for a, n in ((1, 250), (2, 3), (3, 299), (4, 256)) for k in range(600)]
    rows += [(5, k % 256, k // 256, 7, 255) for k in range(500)] + [(6, 0, 0, 0, 0)] * 5
    df = spark.createDataFrame(rows, "anim_id int, r int, g int, b int, a int").repartition(4)
    got = {r.anim_id: (r.slots, r.saturated) for r in K.palette_capped(df).collect()}
    assert got == {1: (251, False), 2: (4, False), 3: (300, True), 4: (257, False), 5: (300, True), 6: (1, False)}
    exact = {r.anim_id: r.slots for r in K.palette_stats(df).collect()}
    assert all(got[a] == (min(n, 300), n >= 300) for a, n in exact.items())


def test_pruned_scan_reads_fewer_row_groups(spark, tmp_path):
    """Bounds of the assets reach the stored column: most rows are never read, the result is the same."""
    rows = spark.range(200_000).select(
        F.col("id").alias("sample_id"), (F.col("id") % 3).alias("asset_id"),
        F.timestamp_micros(F.col("id") * 1000).alias("ts"), (F.col("id") * 1000).alias("t_us"))
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # the default has no statistics
    for kind, column in (("timestamp", "ts"), ("bigint", "t_us"), ("timestamp_ntz", "ts")):
        path = f"{tmp_path}/{kind}"
        rows.withColumn("ts", F.col("ts").cast(kind if column == "ts" else "timestamp")).coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(path)
        assets = spark.createDataFrame([(0, 50_000_000, 52_000_000), (1, 51_000_000, 53_000_000)], "asset_id long, in_us long, out_us long")
        stored = spark.read.parquet(path)
        near = intervals.prune_to_assets(stored, assets, column)
        read = near.select("sample_id", column)
        n = len(read.collect())
        assert n == 3000
        plan = read._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        assert f"PushedFilters: [IsNotNull({column}), GreaterThanOrEqual({column}" in plan.toString()
        assert kind == "timestamp_ntz" or leaf.metrics().apply("numOutputRows").value() < 20_000
        want = sorted(tuple(r) for r in intervals.trim_window(stored, assets).collect())
        assert sorted(tuple(r) for r in intervals.trim_window(near, assets).collect()) == want and want
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
